"""SQL twins of the problems' queries, where SQL can express them on whole tables."""

WHITE = r"\p{Z}\t\n\v\f\r\x{85}"

P6_PAGES = r"""
with d as (select distinct on (doc_id) doc_id, text from corpus_pages),
f as (select doc_id, lower(replace(text, 'İ', 'i̇')) as t from d where text is not null and not regexp_full_match(text, '[WHITE]*')),
w as (select doc_id, unnest(regexp_extract_all(t, '[\p{L}\p{M}]+')) as term from f),
c as (select term, count(*)::bigint as occurrences, count(distinct doc_id)::bigint as records from w group by term)
""".replace("WHITE", WHITE)

P6_VOCAB = """
l as (select word, batch_no, max_by(cn, (saved_at, vocab_id)) as cn from vocab_words where word is not null and cn is not null group by word, batch_no),
v as (select word as term, sum(cn)::bigint as occurrences, count(*)::bigint as batches from l group by word)
"""


def oracle_sql() -> dict[str, str]:
    stretch = rf"regexp_extract_all(text, '[^{WHITE}.!?。！？…]*[.!?。！？…]?')"
    return {
        "p3_found": f"""
with i as (select 'corpus_pages' as origin, doc_id::varchar as item_key, text from (select distinct doc_id, text from corpus_pages)
           union all select 'squad_examples', question_id, context from (select distinct question_id, context from squad_examples))
select origin, item_key, case when list_max(list_transform({stretch}, lambda x: length(x))) > 2000 then 'forced' else 'natural' end as cut_kind
from i where length(text) > 2000""",
        "p6_found": f"""{P6_PAGES}, {P6_VOCAB}
select 'corpus_pages' as origin, term, 'rare' as mark from c where occurrences < 3
union all select 'corpus_pages', term, 'common' from c where records * 4 > (select count(*) from f)
union all select 'vocab_words', term, 'rare' from v where occurrences > 0 and occurrences < 5
union all select 'vocab_words', term, 'common' from v where occurrences > 0 and occurrences * 200 > (select sum(occurrences) from v)""",
        "p8_exact": "select doc_id, true as is_exact from documents",
        "p9_bounds": "select true as is_least, true as none_over",
        "p6_page_terms": f"{P6_PAGES} select term, occurrences, records from c",
        "p6_vocab_terms": f"with {P6_VOCAB.strip()} select term, occurrences, batches from v where occurrences > 0",
    }
