"""Row types of the item bank. Order is data: every list carries an explicit ord column."""

from __future__ import annotations

PAGES = "file string, page_no int, text string"
LINES = "file string, n int, line string"
QUESTION_FIELDS = (
    "id string, chapter string, marks int, year int, question string, answer string, "
    "bookmarked boolean, solved boolean, in_syllabus boolean, removed_reason string"
)
QUESTION = "ord long, " + QUESTION_FIELDS
CHAPTER_FIELDS = "name string, count long, count_total long, years array<int>, marks_dist map<string,long>, slug string"
CHAPTER = "ord int, " + CHAPTER_FIELDS
SOLVED = "file string, pair_ord int, year int, q_num int, question string, answer string"
RULE = "rule_ord int, chapter string, kw_ord int, keyword string, label string"
ANSWER = "ord long, id string, answer string"
TOGGLE = "seq long, user string, kind string, id string"
SEGMENT = "type string, content string, label string"
ROOT = (
    "chapters array<struct<name:string,count:bigint,count_total:bigint,years:array<int>,marks_dist:map<string,bigint>,slug:string>>, "
    "questions array<struct<id:string,chapter:string,marks:int,year:int,question:string,answer:string,"
    "bookmarked:boolean,solved:boolean,in_syllabus:boolean,removed_reason:string>>, total bigint, matched_answers bigint"
)
