"""Secret scans over an incremental blob ledger.

Every historical version of a file is addressed by the SHA-256 of its content,
so that equal contents under any number of paths are one blob.  A ledger in a
shared folder holds which rules, in which version, each blob was scanned by; a
run scans only the missing (blob, rule, version) triples, appends what it found
and then what it did, and findings of the rules' present versions are joined
back to all paths of a blob.  All of it is DataFrame expressions: no Python runs
on the executors.

Spans come from two native calls for each rule: ``regexp_extract_all`` gives
the matches and ``split`` the text between them; matches are exploded, and the
running sum of their lengths gives code-point offsets.

Defined results: a null text is an empty blob, which has no findings; equal
texts are scanned once and share findings; repeated rows stay repeated; a null
doc_id keeps its row; findings of a rule version that is no longer listed are
left out; a run that was cut short is made up for by the next, and what it had
found counts once; other columns of the input are not looked at, whatever their
names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arterion.llm.common import lean, shared_dir, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of ``pattern`` whose group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A greedy run that is too short has no long enough run inside, so the least lengths of the last two may stand in the
#: patterns.  That isn't so of the first: a short match takes characters at which a longer one could begin.
BASE = (Rule("assign", ASSIGN, 2, 6), Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20), Rule("hex", "[0-9a-f]{24,}", 0, 24))
#: What the ledger's rule set has besides; these only add spans.  None of them can fail far into a long run of letters.
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    Rule("vcs", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", "xox[abprs]-[0-9A-Za-z-]+", 0, 20),
)
RULES = BASE + MORE
#: Ordered by start, then by rule as listed.
SPAN = "struct<s:int,r:int,e:int,kind:string>"
#: Unseen blobs (of about 100 bytes each) that are broadcast at most; beyond it, texts are shuffled once.
MOST_BROADCAST = 1 << 15
#: Names of a rule's version.
_VERSION = "struct<kind:string,version:int>"


def content(text: str | Column = "text") -> Column:
    """The content address: SHA-256, as bytes."""
    return F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256))


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<r,at,b,m,g>> of one rule: place of a match, and the lengths of what lies before it since the last
    one, of itself and of what is checked."""
    pattern, kind = F.lit(rule.pattern), "struct<r:int,at:int,b:int,m:int,g:int>"
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    zipped = F.filter(F.arrays_zip(whole.alias("m"), checked.alias("g"), F.split(text, rule.pattern, -1).alias("b")), lambda x: x["m"].isNotNull())
    found = F.transform(zipped, lambda x, at: F.struct(F.lit(rank).alias("r"), at.alias("at"), F.length(x["b"]).alias("b"), F.length(x["m"]).alias("m"), F.length(x["g"]).alias("g")).cast(kind))
    return F.when(F.rlike(text, pattern), found).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, version, s, e): the spans of each blob (blob, text, todo), in code points, end exclusive.

    ``todo`` names, as bits, the rules (by place) that a blob still needs.
    """
    each = [F.when(F.col("todo").bitwiseAND(1 << k) != 0, matches(F.col("text"), rule, k)) for k, rule in enumerate(rules)]
    none = F.expr("cast(array() as array<struct<r:int,at:int,b:int,m:int,g:int>>)")
    # explode() would have the optimiser put a filter before it that matches everything once more.
    rows = blobs.select("blob", F.explode_outer(F.concat(*[F.coalesce(x, none) for x in each])).alias("x")).where(F.col("x").isNotNull()).select("blob", "x.*")
    end = F.sum(F.col("b") + F.col("m")).over(Window.partitionBy("blob", "r").orderBy("at")).cast("int")
    rows = rows.distinct().withColumn("e", end).withColumn("s", F.col("e") - F.col("m"))
    listed = F.array(*[F.struct(F.lit(x.kind).alias("kind"), F.lit(x.version).alias("version"), F.lit(x.least).alias("least")) for x in rules])
    rows = rows.withColumn("rule", F.get(listed, F.col("r"))).where(F.col("g") >= F.col("rule.least"))
    return rows.select("blob", "rule.kind", "rule.version", "s", "e")


class Ledger:
    """Two tables in a shared folder, which only grow: ``scanned`` (blob, rules) and ``findings`` (blob, kind, version, s, e)."""

    SCANNED, FINDINGS = f"blob binary, rules array<{_VERSION}>", "blob binary, kind string, version int, s int, e int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name, schema in (("scanned", self.SCANNED), ("findings", self.FINDINGS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(self.SCANNED).parquet(f"{self.path}/scanned")

    def findings(self) -> DataFrame:
        return self.spark.read.schema(self.FINDINGS).parquet(f"{self.path}/findings")

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
        """(blob, path, todo): blobs of ``versions`` with one of their paths, and as bits the rules whose present version
        they were not scanned by.  Only content addresses are shuffled."""
        blobs = versions.select(content().alias("blob"), F.col(path).alias("path")).groupBy("blob").agg(F.min("path").alias("path"))
        done = self.scanned().groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("rules"))
        bit = lambda k, x: F.when(F.coalesce(F.array_contains("rules", F.struct(F.lit(x.kind).alias("kind"), F.lit(x.version).alias("version")).cast(_VERSION)), F.lit(False)), 0).otherwise(1 << k)
        todo = sum((bit(k, x) for k, x in enumerate(rules)), F.lit(0))
        return blobs.join(done, "blob", "left").select("blob", "path", todo.cast("int").alias("todo")).where("todo > 0")

    def run(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> None:
        """Scans what of ``versions`` (path, text) the ledger has not seen by ``rules``, and enters it.

        Each unseen content is looked for in the row of one of its paths.  Its text moves only if the unseen blobs are
        too many to be broadcast, and then once.
        """
        todo_at = f"{self.path}/todo-{uuid.uuid4().hex}"
        with lean(self.spark):
            self.unseen(versions, rules, path).write.parquet(todo_at)
            todo = self.spark.read.parquet(todo_at)
            n = todo.count()
            if n:
                held = versions.select(F.col(path).alias("_path"), content().alias("_blob"), text_or_empty().alias("text"))
                same = F.col("_path").eqNullSafe(F.col("path")) & (F.col("_blob") == F.col("blob"))
                blobs = held.join(F.broadcast(todo) if n <= MOST_BROADCAST else todo.hint("shuffle_hash"), same)
                scan(blobs.select("blob", "text", "todo"), rules).write.mode("append").parquet(f"{self.path}/findings")
                listed = F.array(*[F.struct(F.lit(x.kind).alias("kind"), F.lit(x.version).alias("version")) for x in rules])
                entered = F.filter(listed, lambda x, k: F.array_contains(F.array(*[F.when(F.col("todo").bitwiseAND(1 << j) != 0, j) for j in range(len(rules))]), k))
                todo.select("blob", entered.cast(f"array<{_VERSION}>").alias("rules")).write.mode("append").parquet(f"{self.path}/scanned")

    def joined_back(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
        """(path, blob, spans): one row per version, the spans that the present version of ``rules`` found in its blob."""
        listed = self.spark.createDataFrame([(x.kind, x.version, k) for k, x in enumerate(rules)], "kind string, version int, r int")
        found = self.findings().join(F.broadcast(listed), ["kind", "version"]).groupBy("blob").agg(F.collect_set(F.struct("s", "r", "e", "kind").cast(SPAN)).alias("spans"))
        rows = versions.select(F.col(path).alias("path"), content().alias("blob"))
        return rows.join(found, "blob", "left").select("path", "blob", F.coalesce(F.array_sort("spans"), F.expr(f"cast(array() as array<{SPAN}>)")).alias("spans"))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a new ledger over all documents: by the base rules, then by the longer list, for which only the added
    rules are left to do.  Then all findings are joined back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Ledger(spark, f"{shared_dir(spark)}/arterion/ledger-{uuid.uuid4().hex}")
    ledger.run(docs, BASE)
    ledger.run(docs, RULES)
    rows = ledger.joined_back(docs, RULES)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["r"] < len(BASE))
    return rows.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    parts = []
    for k, r in enumerate(RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(f"""
  SELECT doc_id, '{r.kind}' AS kind, {k} AS r, g, pos,
         list_sum([length(x) for x in b[1:pos]]) + coalesce(list_sum([length(x) for x in m[1:pos-1]]), 0) AS s, length(m[pos]) AS n
  FROM (SELECT doc_id, m, b, unnest(regexp_extract_all(t, {p}, {r.group})) AS g, unnest(range(1, len(m) + 1)) AS pos
        FROM (SELECT doc_id, t, regexp_extract_all(t, {p}, 0) AS m, string_split_regex(t, {p}) AS b FROM d) WHERE len(m) > 0)
  WHERE length(g) >= {r.least}""")
    union = "\n  UNION ALL".join(parts)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({union}),
a AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, r) FILTER (WHERE r < 3), '') AS base,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, r) AS spans
  FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


ORACLE_SQL = _oracle()
