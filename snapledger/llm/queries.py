"""The corpus operators bound to the supplied tables, with production parameters."""

from __future__ import annotations

from snapledger.llm.common import documents
from snapledger.llm.exact import exact_groups
from snapledger.llm.fingerprint import fingerprint_digest
from snapledger.llm.language import language_digest
from snapledger.llm.minhash import near_components
from snapledger.llm.mixing import mix
from snapledger.llm.packing import pack
from snapledger.llm.ranked import ranked_search
from snapledger.llm.secrets import secret_digest
from snapledger.llm.substrings import substring_digest
from snapledger.llm.tokenfiles import token_digest
from snapledger.llm.toxicity import toxicity_digest
from snapledger.llm.warc import warc_round_trip
from snapledger.llm.whitening import whiten


def op1_imatch(spark, folder):
    return fingerprint_digest(documents(spark, folder))


def op2_warc(spark, folder):
    return warc_round_trip(documents(spark, folder, "pages"))


def op3_toxicity(spark, folder):
    return toxicity_digest(documents(spark, folder), documents(spark, folder, "labels"))


def op4_packing(spark, folder):
    return pack(documents(spark, folder))


def op5_mixing(spark, folder):
    return mix(documents(spark, folder))


def op6_near_dedup(spark, folder):
    return near_components(documents(spark, folder))


def op7_substring_dedup(spark, folder):
    return substring_digest(documents(spark, folder))


def op8_language(spark, folder):
    return language_digest(documents(spark, folder))


def op9_exact_dedup(spark, folder):
    return exact_groups(documents(spark, folder))


def op10_secret_scans(spark, folder):
    return secret_digest(documents(spark, folder))


def op11_ranked_search(spark, folder):
    return ranked_search(documents(spark, folder), documents(spark, folder, "benchmark"))


def op12_token_files(spark, folder):
    import public_tokenizers

    return token_digest(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


def op13_whitening(spark, folder):
    return whiten(documents(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_imatch, op2_warc, op3_toxicity, op4_packing, op5_mixing, op6_near_dedup, op7_substring_dedup, op8_language,
        op9_exact_dedup, op10_secret_scans, op11_ranked_search, op12_token_files, op13_whitening,
    )
}

_SPACE = r"[\x20\x09-\x0D]"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op6_near_dedup": rf"""
        with recursive lists as (select doc_id, {_WORDS.replace("text", _LOWER)} as words from documents),
        sets as (
            select distinct doc_id, unnest(list_transform(
                generate_series(1, greatest(1, len(words) - 4)), lambda i: array_to_string(words[i:i + 4], ' '))) as shingle
            from lists where len(words) > 0),
        sizes as (select doc_id, count(*) as n from sets group by doc_id),
        shared as (
            select a.doc_id as a, b.doc_id as b, count(*) as n
            from sets a join sets b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
        links as (
            select a, b from shared s join sizes x on x.doc_id = a join sizes y on y.doc_id = b
            where 100 * s.n >= 75 * (x.n + y.n - s.n)),
        reached as (
            select doc_id, doc_id as other from documents
            union
            select r.doc_id, l.b from reached r join links l on l.a = r.other),
        components as (select doc_id, min(other) as component_id from reached group by doc_id)
        select c.doc_id, coalesce(n, 0) as n_shingles, component_id, c.doc_id = component_id as kept
        from components c left join sizes using (doc_id)""",
    "op7_substring_dedup": rf"""
        with lists as (select doc_id, {_WORDS} as words from documents),
        places as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from lists),
        keys as (
            select doc_id, list_transform(
                generate_series(1, len(words) - 49), lambda i: sha256(array_to_string(words[i:i + 49], ' '))) as k
            from lists where len(words) >= 50),
        windows as (select doc_id, unnest(k) as w, generate_subscripts(k, 1) as i from keys),
        repeated as (
            select doc_id, i from (select *, min(doc_id) over (partition by w) as least from windows) where least < doc_id),
        marked as (
            select p.doc_id, p.i, p.word,
                   count(r.i) over (partition by p.doc_id order by p.i rows between 49 preceding and current row) as covers
            from places p left join repeated r on r.doc_id = p.doc_id and r.i = p.i),
        kept as (
            select doc_id, count(*) filter (covers > 0) as n_removed,
                   string_agg(word, ' ' order by i) filter (covers = 0) as kept_text
            from marked group by doc_id)
        select l.doc_id, len(words) as n_words, coalesce(n_removed, 0) as n_removed,
               sha256(coalesce(kept_text, '')) as kept_sha256
        from lists l left join kept using (doc_id)""",
    "op9_exact_dedup": rf"""
        with t as (
            select doc_id, length(coalesce(text, '')) as chars,
                   sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) as text_sha256
            from documents),
        k as (
            select *, first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id) as keep_id,
                   count(*) over (partition by text_sha256) as group_size
            from t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from k""",
    "op11_ranked_search": rf"""
        with words as (select doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as term from documents),
        held as (select doc_id, term, count(*) as tf from words group by all),
        sizes as (select doc_id, sum(tf)::bigint as n from held group by doc_id),
        total as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sizes),
        weights as (
            select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
            from held, total group by term, n_docs),
        asked as (
            select item_id, term, count(*) as times
            from (select item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as term from benchmark) group by all),
        scores as (
            select item_id, doc_id,
                   sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
            from asked join weights using (term) join held using (term) join sizes using (doc_id), total
            group by item_id, doc_id),
        placed as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
        select item_id, rank::int as rank, doc_id, score from placed where rank <= 20""",
}
