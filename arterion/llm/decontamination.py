"""Benchmark decontamination by template canonicalisation, in DataFrame expressions alone.

Texts become tokens; numbers, units after them and names (capitalised words
inside a sentence) become the placeholders #num, #unit and #name, and all other
words lower-case literals.  Windows of WINDOW template tokens are hashed and
joined with those of the benchmark.  A document that covers enough of an item's
windows is checked slot by slot: wherever the item's template has a
placeholder, one value of the item must always meet one value of the document.
If all windows are found and all values equal, it is a verbatim leak.  The
check is made of the first place of each window and, where a document has
several passages, of each passage alone; one that is consistent is enough.

A second form of windows, "folded", replaces numbers and units only and keeps all
words, lower-cased: so a copy is found too where the case of its words, or what
stands before it, makes other names of them, or where an item has too few words
that are no names.  A folded window with fewer than LITERALS words holds its
tokens as they are.  Folded windows are checked slot by slot like the others, and
passages that windows of the first form have covered are judged by that form
alone, so that none is let in by one form which the other refuses.

Every window has an anchor, the longest literal word of a template or the
longest word of the other form.  A document can cover enough windows only if it
holds the anchors of as many, which a join of its tokens with the anchors tells
at the cost of cutting it; only documents that pass are put into templates.
This leaves out no match, as tokens are cut and lower-cased alike on both sides.

The benchmark's windows are counted first and it is broadcast only up to
``MOST_BROADCAST``; beyond it the joins shuffle words or hashes.  Texts move
only if the documents that pass are too many for their ids to be broadcast.

Defined results: a null or empty text, or item, has no windows and no match;
items shorter than WINDOW are one window of their own length, and such of one or
two tokens only match by template; rows that repeat a doc_id count as one document,
each passage lying in one row, and a row without doc_id is one of its own;
repeated items are one item; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arterion.llm.common import Scratch, among, table, text_or_empty

WINDOW = 8
COVERAGE = 0.5
#: A window with fewer literal words than this says nothing.
LITERALS = 3
#: Widths of the ranges in which places of one passage are sought.
RANGES = (4, 16, 64, 256)
#: Windows of the benchmark that are broadcast at most, of 40 bytes each.
MOST_BROADCAST = 1 << 20
WORD = r"\p{L}+|[0-9]+(?:[.,:/][0-9]+)*"
TOKEN = WORD + r"|[.!?\n]|[%$€£]"
#: The forms of windows, and the least tokens of a folded one.
FORMS, LEAST_FOLDED = ("template", "folded"), 3
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "pound", "pounds", "ounce", "ounces",
    "meter", "meters", "metre", "metres", "gram", "grams", "litre", "litres", "liter", "liters", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degrees",
)
_ENDS, _SIGNS = (".", "!", "?", "\n"), ("%", "$", "€", "£")


def template(text: Column) -> tuple[Column, Callable[[], Column]]:
    """The raw tokens of ``text``, to be a column _raw; and what makes array<struct<c,r>> of that column: the template
    token and the raw one of each word.  Sentence ends are looked at and left out."""
    raw = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def token(at: Column) -> Column:
        t, before = F.get(F.col("_raw"), at), F.when(at > 0, F.get(F.col("_raw"), at - 1))
        first, low = F.substring(t, 1, 1), F.lower(t)
        after_number = F.coalesce(F.substring(before, 1, 1).between("0", "9"), F.lit(False))
        c = (
            F.when(first.between("0", "9"), "#num")
            .when(t.isin(*_SIGNS) | (after_number & low.isin(*UNITS)), "#unit")
            .when(t.isin(*_ENDS), F.lit(None))
            .when((F.lower(first) != first) & (F.length(t) > 1) & before.isNotNull() & ~before.isin(*_ENDS), "#name")
            .otherwise(low)
        )
        return F.struct(c.alias("c"), t.alias("r"))

    return raw, lambda: F.filter(F.transform(F.sequence(F.lit(0), F.size("_raw") - 1), token), lambda x: x["c"].isNotNull())


def templated(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, tokens): the template of each text.

    No filter may follow on what is made here: pushed down, it would take the whole tokenising into the lambda.
    """
    raw, tokens = template(text_or_empty(text))
    return rows.select(key, raw.alias("_raw")).select(key, tokens().alias("tokens"))


def _held(c: Column) -> Column:
    """Is a template token a number or a unit?"""
    return c.isin("#num", "#unit")


def _window(form: str, size: Column, at: Column) -> Column:
    """The hash of ``size`` tokens from ``at`` on, of arrays _c (template tokens), _f (folded), _r (lower-case) and _w (1
    for a word that a folded window keeps, else 0)."""
    hashed = lambda name: F.xxhash64(F.lit(form), size, F.slice(name, at + 1, size))
    if form == "template":
        return hashed("_c")
    words = F.size(F.array_remove(F.slice("_w", at + 1, size), 0))
    return F.when(words >= F.least(F.lit(LITERALS), size), hashed("_f")).otherwise(hashed("_r"))


def _prepared(*keep: str) -> list[Column]:
    """Columns that windows are made of, of ``tokens``; and those to keep."""
    folded = F.transform("tokens", lambda x: F.xxhash64(F.when(_held(x["c"]), x["c"]).otherwise(F.lower(x["r"]))))
    return [*[F.col(c) for c in keep], F.transform("tokens", lambda x: F.xxhash64(x["c"])).alias("_c"), folded.alias("_f"), F.transform("tokens", lambda x: F.xxhash64(F.lower(x["r"]))).alias("_r"), F.transform("tokens", lambda x: F.when(_held(x["c"]), 0).otherwise(1)).alias("_w")]


def document_windows(held: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, row, pos, window): the windows of all forms and sizes, in one pass over ``held``."""
    starts = lambda n: F.when(F.size("_c") >= n, F.sequence(F.lit(0), F.size("_c") - n)).otherwise(F.expr("cast(array() as array<int>)"))

    def of(form: str, size: int) -> Column:
        return F.transform(starts(size), lambda at: F.struct(at.alias("pos"), _window(form, F.lit(size), at).alias("window")))

    forms = [of(form, size) for form in FORMS for size in sizes if form == "template" or size >= LEAST_FOLDED]
    rows = held.select(*_prepared("key", "row")).select("key", "row", F.explode_outer(F.concat(*forms)).alias("x"))
    return rows.select("key", "row", "x.pos", "x.window")


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, tokens, size): one row per item, size being the length of its windows."""
    rows = templated(benchmark.where(F.col("item_id").isNotNull()), "item_id")
    return rows.groupBy("item_id").agg(F.min("tokens").alias("tokens")).withColumn("size", F.least(F.size("tokens"), F.lit(WINDOW))).where(F.col("size") > 0)


def item_windows(listed: DataFrame) -> DataFrame:
    """(item_id, form, size, at, window, anchor, n_windows): windows of templates with enough literal words (as many as a
    short item has), and folded ones of LEAST_FOLDED tokens at least."""
    starts = F.sequence(F.lit(0), F.size("tokens") - F.col("size"))
    rows = listed.select(*_prepared("item_id", "size", "tokens")).withColumn("at", F.explode(starts))
    part = F.slice("tokens", F.col("at") + 1, F.col("size"))
    literal = F.filter(part, lambda x: ~F.startswith(x["c"], F.lit("#")))
    worded = F.filter(part, lambda x: ~_held(x["c"]))
    own = F.when(F.size(worded) >= F.least(F.lit(LITERALS), F.col("size")), worded).otherwise(F.filter(part, lambda x: ~x["r"].isin(*_SIGNS)))
    found = None
    for form, said, fit in (("template", F.transform(literal, lambda x: x["c"]), F.size(literal) >= F.least(F.lit(LITERALS), F.col("size"))), ("folded", F.transform(own, lambda x: F.lower(x["r"])), F.col("size") >= LEAST_FOLDED)):
        # The longest, of several the first by order.
        anchor = F.array_min(F.transform(said, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("c"))))["c"]
        one = rows.where(fit).select("item_id", F.lit(form).alias("form"), "size", "at", _window(form, F.col("size"), F.col("at")).alias("window"), anchor.alias("anchor"))
        found = one if found is None else found.unionByName(one)
    n = found.groupBy("item_id", "form").agg(F.count(F.lit(1)).cast("int").alias("n_windows"))
    return found.join(n, ["item_id", "form"])


def candidates(docs: DataFrame, known: DataFrame, coverage: float, small: bool) -> DataFrame:
    """The ids of documents that hold the anchors of enough windows of some item."""
    key = ["item_id", "form", "n_windows"]
    anchors = known.groupBy(*key, "anchor").agg(F.count(F.lit(1)).alias("weight"))
    # explode() would have the optimiser put a filter before it that cuts the text once more.
    words = docs.select("doc_id", F.explode_outer(F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0))).alias("word")).select("doc_id", F.lower("word").alias("anchor"))
    met = words.join(F.broadcast(anchors) if small else anchors, "anchor").groupBy("doc_id", *key, "anchor").agg(F.max("weight").alias("weight"))
    enough = met.groupBy("doc_id", *key).agg(F.sum("weight").alias("weight")).where(F.col("weight") >= coverage * F.col("n_windows"))
    return enough.select("doc_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, n_slots, verbatim): documents that hold an item, and which.

    ``n_matched``: distinct windows of the item found; ``n_slots``: distinct pairs of slot values that met in
    the passage that decided.
    """
    listed = items(benchmark)
    known = item_windows(listed)
    sizes = {r["size"]: r["n"] for r in known.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # WINDOW rows at most
    if not sizes:
        empty = "doc_id {}, item_id {}, n_matched long, n_windows int, n_slots int, verbatim boolean"
        return docs.sparkSession.createDataFrame([], empty.format(docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()))
    small = sum(sizes.values()) <= most_broadcast
    probe = F.broadcast(known) if small else known
    scratch = Scratch(docs.sparkSession)
    wanted = scratch.keep(candidates(docs, known, coverage, small), "wanted")
    held = templated(among(docs.select("doc_id", "text"), wanted, "doc_id", "left_semi"), "doc_id").withColumn("row", F.monotonically_increasing_id())
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("n"), F.col("row").cast("string")))
    held = scratch.keep(held.select("doc_id", key.alias("key"), "row", "tokens"), "templates")
    met = document_windows(held, sorted(sizes)).join(probe.select("item_id", "form", "at", "window", "n_windows"), "window")
    pairs = met.groupBy("key", "item_id", "form", "n_windows").agg(F.collect_list(F.struct("at", "row", "pos")).alias("places"))
    pairs = pairs.withColumn("n_matched", F.size(F.array_distinct(F.col("places")["at"])).cast("long")).where(F.col("n_matched") >= coverage * F.col("n_windows"))
    pairs = scratch.keep(pairs, "pairs")
    # What the first form has covered is left out of the other: whole passages, by row and distance from the item's place.
    line = lambda p: F.struct(p["row"], p["pos"] - p["at"])
    first = pairs.where("form = 'template'").select("key", "item_id", F.array_distinct(F.transform("places", line)).alias("lines"))
    folded = pairs.where("form = 'folded'").join(first.hint("shuffle_hash"), ["key", "item_id"], "left")
    folded = folded.withColumn("places", F.when(F.col("lines").isNull(), F.col("places")).otherwise(F.filter("places", lambda p: ~F.array_contains("lines", line(p)))))
    folded = folded.withColumn("n_matched", F.size(F.array_distinct(F.col("places")["at"])).cast("long")).where(F.col("n_matched") >= coverage * F.col("n_windows"))
    pairs = pairs.where("form = 'template'").unionByName(folded.select(*pairs.columns))

    pairs = pairs.join(listed.select("item_id", "size", F.col("tokens").alias("own")), "item_id")
    # Only the templates of documents that have a pair are shuffled; pairs are the smaller side, but carry whole items.
    near = held.join(pairs.select("key").distinct().hint("shuffle_hash"), "key", "left_semi")
    both = near.select(F.col("key").alias("_key"), F.col("row").alias("_row"), "doc_id", "tokens").join(pairs.hint("shuffle_hash"), F.col("_key") == F.col("key"))

    def slots(place: Column) -> Column:
        value = lambda name, k: F.when(F.col("form") == "folded", F.lower(F.get(F.col(name), k)["r"])).otherwise(F.get(F.col(name), k)["r"])
        step = lambda k: F.struct(F.get(F.col("own"), place["at"] + k)["c"].alias("kind"), value("own", place["at"] + k).alias("item"), value("tokens", place["pos"] + k).alias("doc"))
        return F.filter(F.transform(F.sequence(F.lit(0), F.col("size") - 1), step), lambda x: F.when(F.col("form") == "template", F.startswith(x["kind"], F.lit("#"))).otherwise(_held(x["kind"])))

    mine = F.transform(F.filter("places", lambda p: p["row"] == F.col("_row")), lambda p: F.struct(p["at"].alias("at"), p["row"].alias("row"), p["pos"].alias("pos"), slots(p).alias("slots")))
    pair = ["key", "item_id", "form"]
    met = both.select(*pair, "doc_id", "n_matched", "n_windows", mine.alias("met")).groupBy(*pair)
    met = met.agg(F.first("doc_id").alias("doc_id"), F.max("n_matched").alias("n_matched"), F.max("n_windows").alias("n_windows"), F.array_sort(F.flatten(F.collect_list("met"))).alias("met"))
    # The first place of each window, wherever in the document it is.
    first = F.filter("met", lambda x, k: (k == 0) | (F.get(F.col("met"), k - 1)["at"] != x["at"]))
    lines = F.size(F.array_distinct(F.transform("met", lambda x: F.struct(x["row"], x["pos"] - x["at"]))))
    met = met.withColumn("slots", F.array_distinct(F.flatten(first["slots"]))).withColumn("lines", lines)
    met = scratch.keep(_judged(met), "met")

    # Where that mixes passages or isn't verbatim, each passage alone.
    mixed = met.where((F.col("lines") > 1) & ~(F.col("consistent") & F.col("same")))
    kept = [*pair, "doc_id", "n_matched", "n_windows"]
    one = mixed.select(*kept, F.explode("met").alias("x")).select(*kept, "x.*", F.explode(_passages(F.col("x.pos") - F.col("x.at"))).alias("passage"))
    by = [*kept, "row", "passage"]
    one = one.groupBy(*by, "at").agg(F.min_by("slots", "pos").alias("slots")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    one = _judged(one.where(F.col("n") >= coverage * F.col("n_windows")))

    names = ["doc_id", "item_id", "n_matched", "n_windows", "n_slots", "verbatim"]
    out = met.where("consistent").select("key", *names, "form", F.lit(1).alias("all")).unionByName(one.where("consistent").select("key", *names, "form", F.lit(0).alias("all")))
    # Templates before folded windows; a verbatim passage before others, the document as a whole before its passages.
    best = F.max(F.struct((F.col("form") == "template").alias("form"), "verbatim", "all", "n_slots", "n_matched", "n_windows")).alias("best")
    out = out.groupBy("key", "item_id").agg(F.first("doc_id").alias("doc_id"), best).select("doc_id", "item_id", *[f"best.{c}" for c in names[2:]])
    out = scratch.keep(out, "leaks")
    scratch.close(out)
    return out


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` with n_slots, same, verbatim and consistent of their ``slots``."""
    values = F.array_distinct(F.transform("slots", lambda x: F.struct(x["kind"], x["item"])))
    same = F.forall("slots", lambda x: x["item"] == x["doc"])
    return rows.withColumns({"n_slots": F.size("slots"), "same": same, "verbatim": same & (F.col("n_matched") == F.col("n_windows")), "consistent": F.size(values) == F.size("slots")})


def _passages(line: Column) -> Column:
    """The passages that a place may belong to, by its distance from the item's place: that distance alone, and
    overlapping ranges of it, as words may be put into or left out of a copy."""
    ranges = [F.struct(F.lit(w).alias("width"), F.lit(h).alias("shift"), F.floor((line + h) / w).cast("long").alias("k")) for w in RANGES for h in (0, w // 2)]
    return F.array(F.struct(F.lit(1).alias("width"), F.lit(0).alias("shift"), line.cast("long").alias("k")), *ranges)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item of the benchmark."""
    return among(docs, contaminated(docs, benchmark).select("doc_id"), "doc_id", "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    signs = ", ".join(f"'{u}'" for u in _SIGNS)
    pattern = TOKEN.replace("\\n", "\n")
    tokens = f"""
  SELECT id, list(struct_pack(c := c, r := t) ORDER BY i) AS tokens FROM (
    SELECT id, i, t, CASE
        WHEN t[1] BETWEEN '0' AND '9' THEN '#num'
        WHEN t IN ({signs}) OR (coalesce(b[1] BETWEEN '0' AND '9', false) AND lower(t) IN ({units})) THEN '#unit'
        WHEN t IN ('.', '!', '?', chr(10)) THEN NULL
        WHEN lower(t[1]) <> t[1] AND length(t) > 1 AND b IS NOT NULL AND b NOT IN ('.', '!', '?', chr(10)) THEN '#name'
        ELSE lower(t) END AS c
    FROM (SELECT id, i, raw[i] AS t, CASE WHEN i > 1 THEN raw[i - 1] END AS b
          FROM (SELECT id, raw, unnest(range(1, len(raw) + 1)) AS i FROM (SELECT @key AS id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS raw FROM @table)))
  ) WHERE c IS NOT NULL GROUP BY id"""
    held = "x.c IN ('#num', '#unit')"
    part = lambda name: f"{name}[s + 1 : s + size]"
    lists = f"id, tokens, [x.c for x in tokens] AS tc, [CASE WHEN {held} THEN x.c ELSE lower(x.r) END for x in tokens] AS tf, [lower(x.r) for x in tokens] AS tr, [CASE WHEN {held} THEN 0 ELSE 1 END for x in tokens] AS tw, [CASE WHEN starts_with(x.c, '#') THEN 0 ELSE 1 END for x in tokens] AS tl"
    starts = "range(0, len(tc) - size + 1)"
    template = f"unnest({starts}) AS s, unnest([CASE WHEN list_sum({part('tl')}) >= least({LITERALS}, size) THEN array_to_string({part('tc')}, ' ') END for s in {starts}]) AS w"
    folded = f"unnest({starts}) AS s, unnest([array_to_string(CASE WHEN list_sum({part('tw')}) >= least({LITERALS}, size) THEN {part('tf')} ELSE {part('tr')} END, ' ') for s in {starts}]) AS w"
    ranges = "[{'w': 1, 'h': 0}, " + ", ".join(f"{{'w': {w}, 'h': {h}}}" for w in RANGES for h in (0, w // 2)) + "]"
    return f"""
WITH d AS (SELECT {lists} FROM ({tokens.replace("@key", "doc_id").replace("@table", "documents")})),
b AS (SELECT {lists}, least(len(tokens), {WINDOW}) AS size FROM ({tokens.replace("@key", "item_id").replace("@table", "benchmark")})),
bw AS (SELECT id AS item_id, 'template' AS form, size, s AS at_, w FROM (SELECT id, size, {template} FROM b) WHERE w IS NOT NULL
       UNION ALL SELECT id, 'folded', size, s, w FROM (SELECT id, size, {folded} FROM b WHERE size >= {LEAST_FOLDED})),
bn AS (SELECT item_id, form, count(*) AS n_windows FROM bw GROUP BY ALL),
ds AS (SELECT id, tc, tf, tr, tw, tl, size FROM d, (SELECT DISTINCT size FROM b) z WHERE len(tc) >= size),
dw AS (SELECT id AS doc_id, 'template' AS form, size, s AS pos, w FROM (SELECT id, size, {template} FROM ds) WHERE w IS NOT NULL
       UNION ALL SELECT id, 'folded', size, s, w FROM (SELECT id, size, {folded} FROM ds WHERE size >= {LEAST_FOLDED})),
m AS (SELECT doc_id, item_id, form, at_, pos FROM dw JOIN bw USING (w, size, form)),
k1 AS (SELECT doc_id, item_id FROM m JOIN bn USING (item_id, form) WHERE form = 'template' GROUP BY ALL HAVING count(DISTINCT at_) >= {COVERAGE} * any_value(n_windows)),
l1 AS (SELECT DISTINCT doc_id, item_id, pos - at_ AS line FROM m JOIN k1 USING (doc_id, item_id) WHERE form = 'template'),
m2 AS (SELECT m.* FROM m WHERE form = 'template' OR NOT EXISTS (SELECT 1 FROM l1 WHERE l1.doc_id = m.doc_id AND l1.item_id = m.item_id AND l1.line = m.pos - m.at_)),
k AS (SELECT doc_id, item_id, form, count(DISTINCT at_) AS n_matched, any_value(n_windows) AS n_windows FROM m2 JOIN bn USING (item_id, form) GROUP BY ALL HAVING n_matched >= {COVERAGE} * n_windows),
g AS (SELECT m2.*, NULL AS passage FROM m2 JOIN k USING (doc_id, item_id, form)
      UNION ALL SELECT doc_id, item_id, form, at_, pos, [r.w, r.h, CAST(floor((pos - at_ + r.h) / r.w) AS BIGINT)] AS passage
      FROM (SELECT m2.*, unnest({ranges}) AS r FROM m2 JOIN k USING (doc_id, item_id, form))),
f AS (SELECT doc_id, item_id, form, passage, at_, min(pos) AS pos FROM g GROUP BY ALL),
c AS (SELECT f.doc_id, f.item_id, f.form, f.passage, any_value(n_matched) AS n_matched, any_value(n_windows) AS n_windows
      FROM f JOIN k ON k.doc_id = f.doc_id AND k.item_id = f.item_id AND k.form = f.form GROUP BY f.doc_id, f.item_id, f.form, f.passage HAVING count(*) >= {COVERAGE} * any_value(n_windows)),
s AS (SELECT DISTINCT doc_id, item_id, form, passage, b.tokens[at_ + j].c AS kind, CASE WHEN form = 'folded' THEN b.tr[at_ + j] ELSE b.tokens[at_ + j].r END AS iv,
             CASE WHEN form = 'folded' THEN d.tr[pos + j] ELSE d.tokens[pos + j].r END AS dv
      FROM f JOIN b ON b.id = item_id JOIN d ON d.id = doc_id, (SELECT unnest(range(1, {WINDOW} + 1)) AS j) g
      WHERE j <= b.size AND CASE WHEN form = 'template' THEN starts_with(b.tokens[at_ + j].c, '#') ELSE b.tokens[at_ + j].c IN ('#num', '#unit') END),
v AS (SELECT doc_id, item_id, form, passage, count(*) AS n, count(DISTINCT kind || chr(1) || iv) AS nv, bool_and(iv = dv) AS same FROM s GROUP BY ALL),
t AS (SELECT c.*, coalesce(n, 0) AS n_slots, coalesce(same, true) AND n_matched = n_windows AS verbatim, coalesce(same, true) AS same
      FROM c LEFT JOIN v ON v.doc_id = c.doc_id AND v.item_id = c.item_id AND v.form = c.form AND v.passage IS NOT DISTINCT FROM c.passage WHERE coalesce(n = nv, true)),
w AS (SELECT doc_id, item_id, form FROM t WHERE passage IS NULL AND same),
u AS (SELECT t.* FROM t WHERE passage IS NULL OR NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = t.doc_id AND w.item_id = t.item_id AND w.form = t.form))
SELECT doc_id, item_id, n_matched, CAST(n_windows AS INTEGER) AS n_windows, CAST(n_slots AS INTEGER) AS n_slots, verbatim FROM u
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY form = 'template' DESC, verbatim DESC, passage IS NULL DESC, n_slots DESC, n_matched DESC) = 1
"""


ORACLE_SQL = _oracle()
