"""Language ID by Bayesian evidence fusion.

For a web page, the likelihood of its text (hashed byte trigrams, tempered), of
the language that its markup declares and of the language that its address
names are multiplied with a prior of its host.  Host priors are smoothed
hierarchically (host in registered domain in suffix in all pages) from grouped
sums of text posteriors; likelihoods of declared and address languages come from
the same kind of sums.  A page's own text is taken out of its priors, so that no
evidence counts twice.  Only small rows of numbers are shuffled.

The text model is fitted on the driver on a bounded sample of each language of
the documents; languages are counted over all documents, and everything else
over all pages.  A language that only pages declare has no text to fit on and
counts as "other".

Defined results: a null or empty page has a flat text likelihood and is decided
by the rest; a null or malformed address has host "" of suffix ""; an unknown
declared language counts as the kind "other", none as "none"; ties go to the
language first in alphabet; repeated rows each count; further columns are not
looked at, whatever their names; an empty table of pages gives no rows, one of
documents the single language "und".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arterion.llm.common import join_hot, Scratch, table, tidied

#: Documents that the text model is fitted on, dealt evenly over the languages, of which each has so many at least.
MOST_DOCUMENTS, LEAST_EACH = 4_000, 25
BUCKETS = 1 << 15
#: A text counts as at most this many independent trigrams.
EVIDENCE = 40.0
#: Weight of a parent's prior, in pages.
SMOOTH = 5.0
#: What isn't text: each kind's opening and closing mark.
_BLOCKS = [(re.compile(rf"<{x}\b.*?</{x}\s*>", re.S | re.I), re.compile(rf"</{x}\s*>", re.I)) for x in ("script", "style", "nav", "footer")] + [(re.compile("<!--.*?-->", re.S), re.compile("-->"))]
_TAG = re.compile("<[^<>]*>")
_ENTITY = re.compile(r"&[#\w]+;")
_DECLARED = re.compile(r"<html\b[^<>]*?(?<![\w-])lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?![A-Za-z])", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)
_PATH = re.compile(r"^[a-z][a-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#_-]|$)", re.I)


def visible(html: str | None) -> str:
    """The text of a page without scripts, styles, navigation, comments, tags and entities.

    Beyond the last closing mark no opening one is looked for, so a page of unclosed marks takes linear time.
    """
    html = html or ""
    for block, close in _BLOCKS:
        end = max((m.end() for m in close.finditer(html)), default=0)
        html = (block.sub(" ", html[:end]) + html[end:]) if end else html
    return _ENTITY.sub(" ", _TAG.sub(" ", html))


def declared(html: str | None) -> str:
    found = _DECLARED.search(html or "")
    return found[1].lower() if found else "none"


def address(url: str | None) -> tuple[str, str, str, str]:
    """(host, registered domain, suffix, language that the address names or "none")."""
    found = _HOST.search(url or "")
    host = found[1].lower().rstrip(".") if found else ""
    parts = host.split(".")
    suffix = parts[-1] if len(parts) > 1 else ""
    path = _PATH.search(url or "")
    return host, ".".join(parts[-2:]), suffix, path[1].lower() if path else suffix if len(suffix) == 2 else "none"


def trigrams(text: str) -> np.ndarray:
    """Buckets of the UTF-8 byte trigrams of the lower-cased text."""
    b = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages

    def likelihood(self, text: str) -> np.ndarray:
        """Log likelihood by language, tempered, the best one 0."""
        at = trigrams(text)
        if len(at) < 2:
            return np.zeros(len(self.languages))
        x = self.log_p[at].sum(0) * min(1.0, EVIDENCE / len(at))
        return x - x.max()


def fit_text(docs: DataFrame, most: int = MOST_DOCUMENTS) -> TextModel:
    """The trigram model of ``docs`` (doc_id, text, lang): all languages of documents with a doc_id, and of each the
    first documents by hash of doc_id, an equal part of ``most`` but ``LEAST_EACH`` at least.

    Trigrams are counted where the texts lie, whole texts of any length; the driver gets a number for each bucket and
    language.
    """
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang").distinct()
    held = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}  # a row per language
    languages = sorted(held) or ["und"]
    each = max(LEAST_EACH, most // len(languages))
    # Of a common language, a part of the hash range that holds about twice as many as are taken.
    parts = docs.sparkSession.createDataFrame([(x, 1.0 if n <= 2 * each else 2 * each / n) for x, n in held.items()], "lang string, part double")
    near = ids.join(F.broadcast(parts), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("part") * (1 << 30))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = near.withColumn("place", first).where(F.col("place") <= each).select("doc_id", "lang")
    place = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                k = place[lang]
                seen[k] = seen.get(k, 0) + np.bincount(trigrams(text.as_py() or ""), minlength=BUCKETS)
        for k, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["k", "bucket", "n"])

    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id", "lang"]).select("text", "lang")
    got = rows.mapInArrow(tidied(count), "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((BUCKETS, len(languages)), 0.05)
    counts[got.column("bucket").to_numpy(), got.column("k").to_numpy()] += got.column("n").to_numpy()
    return TextModel(languages, np.log(counts / counts.sum(0)).astype(np.float64))


def evidence(pages: DataFrame, model: TextModel, key: str = "page_id") -> DataFrame:
    """(key, host, domain, suffix, declared, named, like): what each page says; ``like``: log likelihood by language."""
    kind = pages.schema[key].dataType.simpleString()
    held = pages.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        code = lambda x: x if x == "none" or x in model.languages else "other"
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = batch.slice(start, 1000)
                at = [address(x.as_py()) for x in rows.column(1)]
                html = [x.as_py() for x in rows.column(2)]
                cols = [pa.array([x[k] for x in at]) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *cols, pa.array([code(declared(x)) for x in html]), pa.array([code(x[3]) for x in at]), pa.array([model.likelihood(visible(x)).tolist() for x in html], pa.list_(pa.float64()))],
                    [key, "host", "domain", "suffix", "declared", "named", "like"],
                )

    return pages.select(key, "url", "html").mapInArrow(tidied(work), f"`{key}` {kind}, host string, domain string, suffix string, declared string, named string, like array<double>")


def _normal(x: Column) -> Column:
    """Weights that sum to 1."""
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return F.transform(x, lambda v: v / total)


def _sums(rows: DataFrame, by: list[str], name: str, n: int) -> DataFrame:
    """Sums of the text posteriors of each group, one value per language.  Partial sums leave each task once a group."""
    out = rows.groupBy(*by).agg(*[F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(n)])
    return out.select(*by, F.array(*[f"s{k}" for k in range(n)]).alias(name))


def identify(pages: DataFrame, model: TextModel, key: str = "page_id") -> DataFrame:
    """(key, lang, probability, text_lang, declared, named, host): the fused decision, with what it rests on."""
    langs, n = model.languages, len(model.languages)
    # The pages are read once; seven grouped sums and the decision start from the small rows that are left of them.
    scratch = Scratch(pages.sparkSession)
    rows = scratch.keep(evidence(pages, model, key).withColumn("post", _normal(F.transform("like", lambda v: F.exp(v)))).drop("like"), "evidence")
    less = lambda s: F.zip_with(s, "post", lambda a, b: F.greatest(F.lit(0.0), a - b))

    def lean(own: Column, parent: Column) -> Column:
        """Posterior mean of a Dirichlet whose mean is the parent's."""
        total = F.aggregate(own, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(own, parent, lambda a, b: (a + SMOOTH * b) / (total + SMOOTH))

    total = rows.agg(*[F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(n)]).first()  # a number per language
    whole = F.array(*[F.lit(float(x or 0.0)) for x in total])
    # Sums of domains and suffixes come to the pages by way of their hosts; suffixes, domains and hosts can be hot.
    add = lambda name: [F.sum(F.col(name)[k]).alias(f"s{k}") for k in range(n)]
    arrayed = lambda df, by, name: df.select(*by, F.array(*[f"s{k}" for k in range(n)]).alias(name))
    hosts = scratch.keep(arrayed(rows.groupBy("host", "domain", "suffix").agg(*add("post")), ["host", "domain", "suffix"], "host_sum"), "hosts")
    domains = scratch.keep(arrayed(hosts.groupBy("domain", "suffix").agg(*add("host_sum")), ["domain", "suffix"], "domain_sum"), "domains")
    suffixes = scratch.keep(arrayed(domains.groupBy("suffix").agg(*add("domain_sum")), ["suffix"], "suffix_sum"), "suffixes")
    domains = scratch.keep(join_hot(domains, suffixes, "suffix").drop("suffix"), "domains")
    hosts = scratch.keep(join_hot(hosts.select("host", "domain", "host_sum"), domains, "domain").drop("domain"), "hosts")
    both = join_hot(rows, hosts, "host")
    both = both.join(F.broadcast(_sums(rows, ["declared"], "declared_sum", n)), "declared").join(F.broadcast(_sums(rows, ["named"], "named_sum", n)), "named")  # a row per language and 2 more each
    flat = F.array(*[F.lit(1.0 / n)] * n)
    both = both.withColumn("base", lean(less(whole), flat))
    both = both.withColumn("prior", lean(less(F.col("suffix_sum")), F.col("base")))
    both = both.withColumn("prior", lean(less(F.col("domain_sum")), F.col("prior")))
    both = both.withColumn("prior", lean(less(F.col("host_sum")), F.col("prior")))

    def likely(sums: str) -> Column:
        """P(kind | language) up to a factor: pages of the language that are of this kind, against all of the language."""
        return F.zip_with(less(F.col(sums)), "base", lambda a, b: (a + 0.5 * b) / (b + F.lit(1e-9)))

    weight = lambda kind, col: F.when(F.col(kind) == "none", flat).otherwise(_normal(col))
    both = both.select(
        key, "host", "declared", "named", "post", "prior", weight("declared", likely("declared_sum")).alias("ld"), weight("named", likely("named_sum")).alias("ln"),
    )
    fused = F.zip_with(F.zip_with("post", "prior", lambda a, b: a * b), F.zip_with("ld", "ln", lambda a, b: (a + 0.01 / n) * (b + 0.01 / n)), lambda a, b: a * b + 1e-300)
    both = both.select(key, "host", "declared", "named", "post", _normal(fused).alias("p"))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda x: F.get(names, F.array_position(x, F.array_max(x)).cast("int") - 1)
    out = both.select(key, best(F.col("p")).alias("lang"), F.array_max("p").alias("probability"), best(F.col("post")).alias("text_lang"), "declared", "named", "host")
    out = scratch.keep(out, "languages")
    scratch.close(out)
    return out


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), fit_text(table(spark, sf_dir, "documents")))
