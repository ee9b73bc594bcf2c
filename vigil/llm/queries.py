"""The registered queries of this subpackage, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import conversation_queries


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.mixing import mix_digest

    return mix_digest(documents(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.language import language_digest

    return language_digest(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.quality_rules import quality

    return quality(documents(spark, sf_dir))


def op4_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.phrase_automata import without_repeats

    return without_repeats(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.exact_dedup import exact_duplicates

    return exact_duplicates(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.line_dedup import line_digest

    return line_digest(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.license_scan import license_scan

    return license_scan(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.suffix_dedup import repeated_passages

    return repeated_passages(documents(spark, sf_dir))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.ngram_join import join_digest

    return join_digest(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vigil.llm.bpe import token_digest

    return token_digest(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.minhash_join import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language": op2_language,
    "op3_quality_rules": op3_quality_rules,
    "op4_phrase_automata": op4_phrase_automata,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_bpe": op10_bpe,
    "op12_minhash_dedup": op12_minhash_dedup,
    **conversation_queries.QUERIES,
}

UPPER_TO_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: The notices of op7 as the brute-force comparison reads them: label, words of a window, tokens.
NOTICES = """
('apache-2.0', 16, ['2', '0', 'apache', 'license', 'licensed', 'the', 'under', 'version']),
('bsd', 28, ['and', 'are', 'binary', 'forms', 'in', 'modification', 'or', 'permitted', 'redistribution', 'source', 'use', 'with', 'without']),
('cc-by-4.0', 26, ['0', '4', 'a', 'attribution', 'commons', 'creative', 'international', 'is', 'license', 'licensed', 'this', 'under', 'work']),
('cc-by-nc-4.0', 14, ['0', '4', 'by', 'cc', 'licensed', 'nc', 'under']),
('gpl-3.0', 24, ['3', 'general', 'gnu', 'is', 'license', 'licensed', 'public', 'the', 'this', 'under', 'version', 'work']),
('mit', 10, ['license', 'mit', 'released', 'the', 'under']),
('mit-grant', 32, ['a', 'any', 'charge', 'copy', 'free', 'granted', 'hereby', 'is', 'obtaining', 'of', 'permission', 'person', 'software', 'this', 'to']),
('mpl-2.0', 34, ['0', '2', 'code', 'form', 'is', 'license', 'mozilla', 'of', 'public', 'source', 'subject', 'terms', 'the', 'this', 'to', 'v']),
('public-domain', 22, ['and', 'domain', 'free', 'into', 'is', 'public', 'released', 'software', 'the', 'this', 'unencumbered'])"""
WORDS7 = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLES = {
    "op7_license_scan": f"""
with d as (select doc_id, translate(coalesce(text, ''), {UPPER_TO_LOWER}) as t from documents),
w as (select doc_id, regexp_extract_all(t, {WORDS7}) as w from d),
p as (select doc_id, len(w) as n_words,
  list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' and coalesce(w[i + 2] = 'by', false)) as cc,
  list_filter(range(len(w)), lambda i: w[i + 1] = 'general' and coalesce(w[i + 2] = 'public' and w[i + 3] = 'license', false)) as gpl,
  list_filter(range(len(w)), lambda i: w[i + 1] = 'all' and coalesce(w[i + 2] = 'rights' and w[i + 3] = 'reserved', false)) as res
  from w),
n(label, width, tokens) as (values {NOTICES}),
a as (select doc_id, w, label, width, tokens from w, n where len(list_intersect(w, tokens)) >= 0.8 * len(tokens)),
b as (select doc_id, label, tokens, w[i + 1:i + width] as part from (select *, unnest(range(len(w))) as i from a)),
m as (select doc_id, label, max(len(list_intersect(part, tokens)) / len(tokens)) as best from b
  where len(list_intersect(part, tokens)) >= 0.8 * len(tokens) group by all),
f as (select doc_id, list(label) as more, max(best) as best from m group by doc_id),
s as (select p.*, list_concat(cc, list_concat(gpl, res)) as places,
  list_concat(case when len(cc) > 0 then ['cc-by'] else [] end, list_concat(case when len(gpl) > 0 then ['gpl'] else [] end,
    case when len(res) > 0 then ['reserved'] else [] end)) as named, coalesce(more, []) as more, coalesce(best, 0.0) as best
  from p left join f using (doc_id))
select doc_id, n_words, len(places)::bigint as n_base, list_min(places) as first_word, list_max(places) as last_word,
  array_to_string(named, ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(named, more))), ',') as labels,
  greatest(best, case when len(places) > 0 then 1.0 else 0.0 end)::double as score
from s""",
    "op3_quality_rules": r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, string_split(t, chr(10)) as ls from d),
g as (select doc_id, unnest(range(len(w) - 2)) as i, w from w where len(w) >= 3),
h as (select doc_id, i, count(*) over (partition by doc_id, w[i + 1], w[i + 2], w[i + 3]) as n from g),
r as (select doc_id, count(distinct x) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as x from h where n > 1)
  group by doc_id),
m as (select doc_id, t, len(ls) as n_lines, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) as n_symbols,
  len(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
    - len(list_distinct(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) as n_dup_lines,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as capitals,
  length(t) - length(regexp_replace(t, '!', '', 'g')) as bangs,
  length(regexp_replace(t, '[^\pL]', '', 'g')) as letters,
  coalesce(n_repeat_words, 0) as n_repeat_words from w left join r using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols > 0.2 * n_words or word_chars < 2 * n_words or word_chars > 15 * n_words
    or n_dup_lines > 0.5 * n_lines or capitals > 0.5 * word_chars or bangs > 0.5 * n_words or letters < 0.5 * word_chars) as kept
from f""",
    "op4_phrase_automata": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, unnest(range(len(w) - 12)) as i, w from d where len(w) >= 13),
h as (select doc_id, i, min(doc_id) over (partition by array_to_string(w[i + 1:i + 13], ' ')) as least from p),
r as (select distinct doc_id, unnest(range(i, i + 13)) as i from h where least < doc_id),
k as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from d),
s as (select k.doc_id, count(r.i) as n_removed, string_agg(word, ' ' order by k.i) filter (where r.i is null) as kept
  from k left join r on k.doc_id = r.doc_id and k.i = r.i group by k.doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join s using (doc_id)""",
    "op5_exact_dedup": """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))""",
    "op6_line_dedup": f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d),
k as (select *, translate(trim(line, {SPACES}), {UPPER_TO_LOWER}) as key from l),
g as (select key, max(doc_id) as last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select doc_id, count(*) as n_lines, count(*) filter (where doc_id < last) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where last is null or doc_id = last), ''))
    as kept_sha256
from k left join g using (key) group by doc_id""",
    "op12_minhash_dedup": f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_TO_LOWER}), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) end) as grams from d),
c as (select min(doc_id) as node, len(any_value(grams)) as n, list_sort(any_value(grams)) as grams from s where len(grams) > 0 group by list_sort(grams)),
g as (select node, n, unnest(grams) as gram from c),
p as (select x.node as a, y.node as b, count(*) as n_both, any_value(x.n) as n_a, any_value(y.n) as n_b
  from g x join g y on x.gram = y.gram and x.node < y.node
    and 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) group by x.node, y.node),
l as (select a, b from p where 100 * n_both >= 85 * (n_a + n_b - n_both)),
e as (select a, b from l union all select b, a from l),
r as (select node as a, node as b from c union select r.a, e.b from r join e on r.b = e.a),
m as (select a as node, min(b) as component_id from r group by a)
select s.doc_id, len(s.grams)::bigint as n_shingles, coalesce(m.component_id, s.doc_id) as component_id,
  s.doc_id = coalesce(m.component_id, s.doc_id) as kept
from s left join c on list_sort(s.grams) = c.grams left join m on m.node = c.node""",
    **conversation_queries.ORACLES,
}
