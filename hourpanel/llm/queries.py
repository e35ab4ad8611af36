"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, collocations, conversation_repair, exact_dedup, language_id, packing, pii_surrogates, quality_hosts, secret_ledger, sentencepiece_viterbi
from . import simhash_dedup, url_filter, warc_bundles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The key of the surrogates; a real run passes a secret of its own.
SURROGATE_KEY = "hourpanel"
# The rules that op3 judges by.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: The block list that decides where no rule fits: the corpus's hosts with a label of words joined by single hyphens, a
#: lexical sign of advertising and spam hosts.  A real run passes a list of its own.
BLOCKED_LABEL = "[a-z]+(-[a-z]+)+"


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and hash of its ids, and whether they decode to its text."""
    path = _tokenizer_file("piece_bpe_32k.model")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("original"))
    coded = sentencepiece_viterbi.encode(docs, path)
    sized = coded.select("doc_id", "original", "ids", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"))
    return sentencepiece_viterbi.decode(sized, path).select(
        "doc_id", "n_tokens", "ids_hash", F.col("text").eqNullSafe(F.translate("original", "▁", " ")).alias("round_trip"))


@_query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs)
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                      F.size("spans").cast("long").alias("n_spans"))


@_query("op3_url_filters", f"""
with u as (
  select page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*(/[^?#]*)', 1) else '' end as path
  from pages),
r(rhost, rpath, rverdict) as (values {", ".join(map(str, URL_RULES))}),
fit as (
  select page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) as rule,
         arg_max(rverdict, length(rhost || rpath)) as rverdict
  from (select distinct page_id, host, path from u) join r
    on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by page_id, host, path)
select u.page_id, u.host, u.path, fit.rule,
       coalesce(fit.rverdict, case when regexp_matches(u.host, '(^|[.]){BLOCKED_LABEL}($|[.])')
                              then 'block' else 'allow' end) as verdict
from u left join fit on u.page_id is not distinct from fit.page_id and u.host = fit.host and u.path = fit.path
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    hosts = pages.select(url_filter.url_host(F.col("url")).alias("host")).distinct()
    blocked = hosts.where(F.exists(F.split("host", r"\."), lambda x: x.rlike(rf"^{BLOCKED_LABEL}\z")))
    return url_filter.judge_urls(pages, rules, blocked).select("page_id", "host", "path", "rule", "verdict")


@_query("op4_pii_surrogates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the rewritten text, and how many mentions of each kind were replaced."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii_surrogates.pseudonymise(docs, SURROGATE_KEY, counts="mentions")
    return out.select("doc_id", "text", *[F.col("mentions")[k].alias(f"n_{k}") for k in pii_surrogates.KINDS])


_DEDUP_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n_cp, row_number() over () as rid,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as text_sha256
  from documents),
w as (
  select *, count(*) over (partition by text_sha256) as group_size,
         first_value(doc_id) over o as keep_id, first_value(rid) over o as keep_rid
  from d window o as (partition by text_sha256 order by n_cp desc, doc_id nulls last, rid))
select doc_id, keep_id, group_size, rid = keep_rid as kept, text_sha256 from w
"""


@_query("op5_exact_dedup", _DEDUP_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_classes(_read(spark, sf_dir, "documents"))


@_query("op6_warc_bundles", f"""
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
  from pages),
g as (select html, max(page_id) as first from p where payload_bytes >= {warc_bundles.REVISIT_BYTES} group by html having count(*) > 1)
select page_id, payload_bytes, payload_digest,
       case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when first is not null and page_id is distinct from first then first end as refers_to
from p left join g using (html)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc_bundles.new_archive(spark)
    index = warc_bundles.write_bundles(_read(spark, sf_dir, "pages"), path)
    return warc_bundles.read_records(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _spans_text(spans: str, keep=None) -> F.Column:
    chosen = F.filter(spans, keep) if keep else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _ledger_sql() -> str:
    one = """
  select rid, '{kind}' as kind, {rank} as rank, unnest(m) as m, unnest(p[:len(m)]) as p, unnest(range(1, len(m) + 1)) as i
  from (select rid, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as p from d)"""
    parts = " union all ".join(one.format(kind=r.kind, rank=k, pattern=r.pattern.replace("'", "''"))
                               for k, r in enumerate(secret_ledger.ALL_RULES))
    assign = secret_ledger.BASE_RULES[0]
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
f as ({parts}),
s as (
  select rid, kind, rank, m, sum(length(p) + length(m)) over (partition by rid, rank order by i) as e from f),
g as (
  select rid, kind, rank, (e - length(m))::bigint as b, e::bigint as e from s
  where kind <> 'assign' or length(regexp_extract(m, '{assign.pattern.replace("'", "''")}', 1)) >= {assign.min_length}),
a as (
  select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
         count(*) filter (kind = 'hex') as n_hex,
         string_agg(kind || ':' || b || ':' || e, ',' order by b, rank) filter (rank < 3) as base,
         string_agg(kind || ':' || b || ':' || e, ',' order by b, rank) as spans
  from g group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (rid)
"""


@_query("op7_secret_ledger", _ledger_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = secret_ledger.findings_by_path(docs, secret_ledger.Ledger(spark))
    base = len(secret_ledger.BASE_RULES)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in secret_ledger.BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(_spans_text("spans", lambda s: s["rank"] < base), 256).alias("base_sha256"),
                        _spans_text("spans").alias("spans"))


def _quality_sql() -> str:
    q = quality_hosts
    rates = ", ".join(f"sum(f_{r}) / sum(n) as m_{r}, sum(f_{r} * f_{r} / n) / sum(n) - (sum(f_{r}) / sum(n)) ** 2 "
                      f"- count(*) * (sum(f_{r}) / sum(n)) * (1 - sum(f_{r}) / sum(n)) / sum(n) as v_{r}" for r in q.RULES)
    weights = ", ".join(f"m_{r}, case when v_{r} > 0 then least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 1.0), 1e6) else 1e6 end as w_{r}" for r in q.RULES)
    fine = " and ".join(f"(f_{r} + m_{r} * w_{r}) / (n + w_{r}) <= least(greatest(m_{r} + {q.DEVIATIONS} * sqrt(m_{r} * (1 - m_{r}) / (w_{r} + 1)), "
                        f"{q.MIN_HOST_RATE}), {q.MAX_HOST_RATE})" for r in q.RULES)
    return fr"""
with d as (
  select row_number() over () as rid, doc_id, source, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') as lines
  from documents),
win as (
  select rid, i, array_to_string(w[i:i + 4], ' ') as t from (select rid, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
twice as (select rid, i from (select *, count(*) over (partition by rid, t) as c from win) where c > 1),
cover as (
  select rid, sum(least(5, i - before)) as n_repeat from (
    select rid, i, coalesce(lag(i) over (partition by rid order by i), i - 5) as before from twice) group by rid),
c as (
  select rid, doc_id, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words
  from d left join cover using (rid)),
f as (
  select *, (n_words < {q.MIN_WORDS})::int as x_short, (100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words)::int as x_repeat,
         (100 * n_symbols > {q.MAX_SYMBOL_PERCENT} * word_chars)::int as x_symbol,
         (100 * n_dup_lines > {q.MAX_DUP_LINE_PERCENT} * n_lines)::int as x_line from c),
h as (select source, count(*)::double as n, {", ".join(f"sum(x_{r})::double as f_{r}" for r in q.RULES)} from f group by source),
m as (select {rates} from h), p as (select {weights} from m),
v as (select source, {fine} as host_ok from h cross join p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (x_short + x_repeat > 0) as base_failed,
       (x_short + x_repeat = 0 and host_ok) as kept
from f left join v on f.source is not distinct from v.source
"""


@_query("op8_quality_hosts", _quality_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_hosts.judge_by_host(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicate_classes(_read(spark, sf_dir, "documents"))


@_query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), _tokenizer_file("byte_bpe_50k.json"))


_COLLOCATIONS_SQL = r"""
with d as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
g as (
  select lang, 1 as k, unnest(w) as phrase from w
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w),
f as (select lang, k, phrase, count(*)::hugeint as f from g group by lang, k, phrase),
cut as (
  select lang, k, phrase, f as a, 1 as k1, split_part(phrase, ' ', 1) as head, substr(phrase, strpos(phrase, ' ') + 1) as tail from f where k > 1 and f >= 10
  union all
  select lang, k, phrase, f, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3) from f where k = 3 and f >= 10),
scored as (
  select cut.lang, cut.k, cut.phrase, a, k1, l.f as l, r.f as r, head, tail, 1000000::hugeint * a * a // (l.f * r.f) as score
  from cut join f l on l.lang = cut.lang and l.phrase = head join f r on r.lang = cut.lang and r.phrase = tail),
low as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k1) = 1),
inner_pairs as (
  select lang, tail as phrase from scored where k = 3 and k1 = 1 and 100 * a >= 50 * r
  union select lang, head from scored where k = 3 and k1 = 2 and 100 * a >= 50 * l),
kept as (select * from low where not exists (select 1 from inner_pairs i where i.lang = low.lang and i.phrase = low.phrase)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join (select lang, sum(f) as n from f where k = 1 group by lang) using (lang)
where rank <= 2000
"""


@_query("op11_collocations", _COLLOCATIONS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


@_query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = conversation_repair.damage(turns)
    plans = conversation_repair.with_empty(conversation_repair.plan(rows), turns)
    return conversation_repair.digests(rows, plans).select(
        "conv_id", *conversation_repair.COUNTS, "cost", "audit", "repaired_sha256")


@_query("op13_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and hash of its ids, and the hash of the text they decode to."""
    path = _tokenizer_file("byte_bpe_50k.json")
    docs = _read(spark, sf_dir, "documents")
    coded = bpe_tree.encode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path)
    sized = coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))
    return bpe_tree.decode(sized, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
