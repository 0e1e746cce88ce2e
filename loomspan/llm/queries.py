"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.common import Scratch, table


def vocabulary() -> str:
    """Path of the public byte-level BPE vocabulary; it is read in place, never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.token_output import read_documents, write_shards

    scratch = Scratch(spark, "op2")
    return read_documents(write_shards(table(spark, sf_dir, "documents"), vocabulary(), scratch))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.license_scan import licences

    return licences(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.secret_scan import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"), Scratch(spark, "op5"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"), Scratch(spark, "op7")))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op8"), width=3, percent=85)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"), Scratch(spark, "op9"))


def op10_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.bpe_stream import encode_decode_digests

    return encode_decode_digests(table(spark, sf_dir, "documents"), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_output": op2_token_output,
    "op3_license_scan": op3_license_scan,
    "op4_secret_scan": op4_secret_scan,
    "op5_html_extract": op5_html_extract,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_neardup": op8_neardup,
    "op9_url_filter": op9_url_filter,
    "op10_bpe_stream": op10_bpe_stream,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x00-/:-`{{-\\x7f]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op6_decontaminate": f"""
        with d as (select doc_id, {_WORDS} as w from documents),
        b as (select item_id, {_WORDS} as w from benchmark),
        bl as (select item_id, w, least(len(w), 10) as n from b where len(w) > 0),
        wins as (select distinct item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') as g
                 from bl, lateral (select unnest(generate_series(1, len(w) - n + 1)) as s)),
        lens as (select distinct n from wins),
        dg as (select doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') as g
               from d, lens, lateral (select unnest(generate_series(1, len(w) - n + 1)) as s) where len(w) >= n),
        m as (select doc_id, n, s, item_id from dg join wins using (n, g)),
        hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) as p from m) group by doc_id),
        it as (select doc_id, count(distinct item_id) as n_items,
               sha256(string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar))) as items_sha256 from m group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
               cast(coalesce(n_items, 0) as bigint) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
               coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (doc_id) left join it using (doc_id)
    """,
    "op8_neardup": f"""
        with recursive w as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ \\t-\\r]+'), lambda x: x <> '') as w from documents),
        s as (select doc_id, list_distinct(list_transform(generate_series(1, greatest(len(w) - 2, 1)),
              lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) as s from w where len(w) > 0),
        e as (select doc_id, len(s) as n, unnest(s) as g from s),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb
              from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
        l as (select a, b from p where 100 * c >= 85 * (na + nb - c)),
        u as (select a as x, b as y from l union select b, a from l),
        r as (select doc_id as x, doc_id as y from documents union select r.x, u.y from r join u on r.y = u.x)
        select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id, w.doc_id = c.component_id as kept
        from w left join (select doc_id, len(s) as n from s) n using (doc_id)
        join (select x as doc_id, min(y) as component_id from r group by x) c using (doc_id)
    """,
    "op1_exact_dedup": f"""
        with t as (select doc_id, sha256({_LOWER}) as text_sha256 from documents),
        g as (select text_sha256, max(doc_id) as keep_id, cast(count(*) as bigint) as group_size from t group by text_sha256)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
    """,
    "op9_url_filter": r"""
        with recursive p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
        tags as (select url, unnest(regexp_extract_all(html, '(?is)<link\b(?:[^>"'']+|"[^"]*"|''[^'']*'')*>')) as tag from p where contains(url, '://')),
        links as (select url as a, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']([^"'']*)["'']', 1) as b from tags
                  where regexp_matches(tag, '(?is)\brel\s*=\s*["''][^"'']*\bcanonical\b')),
        urls as (select url from p where contains(url, '://') union select a from links union select b from links where contains(b, '://')),
        cut as (select url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) as rest from urls),
        rules(rule, rhost, rpath, says) as (values ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
            ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
        fit as (select url, rule, says, row_number() over (partition by url order by length(rule) desc) as place from cut join rules
                on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)),
        nodes as (select c.url, c.host, c.path, c.host || chr(10) || c.rest as node, f.rule, f.says from cut c left join (select * from fit where place = 1) f using (url)),
        e as (select x.node as a, y.node as b from links l join nodes x on x.url = l.a join nodes y on y.url = l.b),
        sides as (select a, b from e union select b, a from e),
        r as (select distinct a as x, a as y from sides union select r.x, sides.b from r join sides on r.y = sides.a),
        said as (select r.x as node, bool_or(n.says = 'allow') as allowed, bool_or(n.says = 'block') as blocked
                 from r join nodes n on n.node = r.y where n.says is not null group by r.x)
        select p.page_id, coalesce(n.host, '') as host, coalesce(n.path, '') as path, n.rule,
               case when n.says is not null then n.says when s.blocked and not s.allowed then 'block' else 'allow' end as verdict
        from p left join nodes n using (url) left join said s using (node)
    """,
}
