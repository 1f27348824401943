"""Schemas of the inputs, in one place."""

CORPUS = "doc_id bigint, page_id bigint, title string, revision_id bigint, timestamp string, source string, url string, text string"
REVIEWS = "content string, score double, upvotes int"
DOT_LABELS = (
    "row_id string, doc_idx string, doc_id string, char_index string, char string, left_context string, right_context string, window_text string, prev_char string, "
    "next_char string, prev_token string, next_token string, rule_guess string, gold_label string, annotator_note string, dot_idx_in_doc string"
)
PAIRS = "misspelled string, correct string, operation string"
REPORTS = "ticker string, year double, preprocessed_content string"
SQUAD = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"
EVALUATION = "records array<struct<question:string,baseline_answer:string,rag_answer:string,retrieved_files:array<string>>>"
