"""Registered queries of this subpackage and, where SQL can say it, the DuckDB statements that check them."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chains, chat, decontaminate, exact_dedup, jaccard_join, mixing, pii, quality, toxicity, turn_repair, url_rules, warc, whitening
from .store import cut_lineage, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder and read back from there."""
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.encode("html", "UTF-8").alias("payload"))
    manifest = cut_lineage(warc.write_archives(warc.with_roles(pages), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"))
    records = warc.read_archives(manifest, manifest.count()).where("kind = 'record'")
    revisit = F.col("record_type") == "revisit"
    return records.select(F.expr("try_cast(regexp_extract(record_id, '<urn:x-record:(-?[0-9]+)>', 1) AS bigint)").alias("page_id"),
                          F.when(revisit, F.col("payload_length")).otherwise(F.length("payload")).cast("bigint").alias("payload_bytes"),
                          F.when(revisit, F.col("payload_digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"), "record_type",
                          F.when(revisit, F.expr("try_cast(regexp_extract(refers_to, '<urn:x-record:(-?[0-9]+)>', 1) AS bigint)")).alias("refers_to"))


ORACLE["op1_warc_salvage"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
w AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM w"""


@query
def op2_chained_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words or more that a document shares, with edits, with others."""
    return chains.passages(table(spark, folder, "documents"))


@query
def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a passage of a benchmark item: one row per document and item, the best window."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


def chat_events(turns: DataFrame) -> DataFrame:
    """The event log behind the turns: texts stream in pieces; some were first generated otherwise, some were edited."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = turns.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), place.alias("message"))
    piece = 40
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / piece).cast("int")), lambda i: F.substring(F.col("text"), i * piece + 1, F.lit(piece)))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    deltas = F.transform(pieces, lambda p: event("delta", p))
    draft = F.array(event("delta", F.substring(F.col("text"), 1, 7)), event("delta", F.lit(" ### draft </turn>")))
    way = F.pmod(F.xxhash64("conv_id", "message"), F.lit(3))
    story = (F.when(way == 0, deltas).when(way == 1, F.concat(draft, F.array(event("regenerate", F.lit(""))), deltas))
             .otherwise(F.concat(draft, F.array(event("edit", F.get(pieces, F.lit(0)))), F.slice(deltas, 2, 1 << 30))))
    told = rows.select("conv_id", "message", "role", F.posexplode(F.concat(F.array(event("open", F.lit(""))), story)).alias("step", "e"))
    return told.select("conv_id", (F.col("message").cast("bigint") * (1 << 32) + F.col("step")).alias("seq"), "message", "role", "e.kind", "e.text")


@query
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one that imitates the marks: logged as events, folded, rendered, written and read back."""
    given = table(spark, folder, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    marks = spark.sql(r"""SELECT -7L AS conv_id, turn, role, '\\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)""")
    written = cut_lineage(chat.render(chat.fold(chat_events(given.unionByName(marks)))))
    read = written.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
                       F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


ORACLE["op4_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '#', ''))
             + length(text) - length(replace(text, '<', '')) + length(role) + 14 AS chars FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS every,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


@query
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, folder, "documents"))


ORACLE["op5_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

#: Weights of the sources in code point order, repeating.
MIX_WEIGHTS = [5, 2, 1]


@query
def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), MIX_WEIGHTS).drop("source")


@query
def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.components(table(spark, folder, "documents"))


#: The rules of the contract, then words that a page address for training text should not hold.
LISTED_RULES = [url_rules.host_rule("net", "/", "block"), url_rules.host_rule("example.net", "/en/", "allow"),
                url_rules.host_rule("example.com", "/de/", "block"), url_rules.host_rule("org", "/fr/", "allow")]
BLOCKED_WORDS = ["ads", "adserver", "banner", "casino", "checkout", "doubleclick", "gambling", "jackpot", "login", "logout", "porn", "signup", "torrent", "tracker", "xxx"]
URL_RULES = LISTED_RULES + [url_rules.word_rule(w) for w in BLOCKED_WORDS]


@query
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE["op8_url_filter"] = f"""
WITH cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)', 1) AS path FROM cut),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM split, rules
        WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v
       WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9])({"|".join(BLOCKED_WORDS)})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM split LEFT JOIN fit USING (page_id)"""


@query
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


@query
def op10_quality_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that stay, with their log importance weight and Gumbel key."""
    return quality.resample(table(spark, folder, "documents"), table(spark, folder, "labels")).select("doc_id", "log_weight", "key", F.lit(True).alias("kept"))


@query
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable vector on the four leading components, at unit variance."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's probability of the toxic label; the number of its significant passages besides."""
    scored = toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("bigint").alias("n_passages"))


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations with planted faults, and the cheapest repair of each."""
    given = table(spark, folder, "conversations")
    return turn_repair.report(given, cut_lineage(turn_repair.damage(given)))


def _better(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}}"


_FAR = "{'c': 1000000000, 'a': '', 't': ''}"
_USER, _ASSISTANT, _SAID = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
_CLOSED = f"""s0, s1, {_better('s2', *[_way(s, '3', 'I', _USER) for s in ('s0', 's1', 's3')])} AS u, {_better('s3', _way('s2', '3', 'I', _ASSISTANT),
              *[_way(s, '6', 'II', _USER + ' || ' + _ASSISTANT) for s in ('s0', 's1')])} AS s"""


def _stay(initial: str, state: str) -> str:
    return f"CASE WHEN stays AND initial = '{initial}' THEN {_way(state, 'open', 'K', _SAID)} ELSE {_FAR} END"


def _given(state: str, role: str) -> str:
    return f"CASE WHEN stays THEN {_way(state, '3 + open', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} ELSE {_FAR} END"


ORACLE["op13_conversation_repair"] = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
-- CRC-32, bit by bit: each character is mixed in, then eight shifts follow.
way AS (SELECT *, xor(4294967295, list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(range(1, length(k) + 1),
            lambda p: [ascii(substr(k, p::BIGINT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]),
            lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 20 AS way FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
                   CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM way, unnest(range(CASE way WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
                          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                          WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial,
                  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
r AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS open FROM judged),
v AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {{'c': 1000000000::BIGINT, 'a': '', 't': ''}} AS s1,
         {{'c': 1000000000::BIGINT, 'a': '', 't': ''}} AS s2, {{'c': 1000000000::BIGINT, 'a': '', 't': ''}} AS s3 FROM r
  UNION ALL
  SELECT conv_id, i, {_way('s0', '4', 'D')}, {_better(_way('s1', '4', 'D'), _stay('s', 's0'))},
         {_better(_way('u', '4', 'D'), *[_stay('u', s) for s in ('s0', 's1', 's')], *[_given(s, 'user') for s in ('s0', 's1', 's')])},
         {_better(_way('s', '4', 'D'), _stay('a', 'u'), _given('u', 'assistant'))}
  FROM (SELECT v.conv_id, r.i, {_CLOSED}, role, text, initial, stays, open FROM v JOIN r ON v.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = v.i + 1)),
ended AS (SELECT conv_id, {_better('s0', 's')} AS best FROM (SELECT conv_id, {_CLOSED} FROM v
          WHERE i = (SELECT max(i) FROM r WHERE r.conv_id IS NOT DISTINCT FROM v.conv_id))),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN told ON g.conv_id IS NOT DISTINCT FROM told.conv_id
LEFT JOIN ended ON g.conv_id IS NOT DISTINCT FROM ended.conv_id"""
