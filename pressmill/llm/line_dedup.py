"""Line dedup by levelled sorted runs of line hashes.

The index is a set of runs on shared storage, each in the same number of buckets of the hash and sorted by it within them. A
batch of documents is reduced to one entry (hash, documents, largest doc_id) per line key and written the same way; a merge
anti-join against each run, which needs neither a shuffle nor a sort of the runs, finds the keys that no run owns: they become a run of level 0.
Each other entry is a repeat of the run that owns its key. When a level holds `fanout` runs they are merged, with their repeats, into one run of the next. A
key is owned once, so its total is that of its owner: its entry there plus its repeats, and no entries are grouped across runs.

The lines of very frequent keys are found by a broadcast of those keys, at most HEAVY of them whatever the size of the
table, so that no task reads all lines of one key; those of other hot keys by a join on the hash.

Defined results: a null text is one empty line; lines of fewer than `min_chars` code points always stay; a row is a
document, rows with one doc_id and text count once (and each lose the same lines); a null doc_id is less than any other, and keeps a line only if no other
document holds it. A line found several times in the document that keeps it stays each time. Of equal doc_ids with different texts all
keep the line. An empty table gives an empty result. Texts may be of any length: nothing is quadratic in their lines.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, columns, forget, let, save, save_bucketed, table

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 3
ROWS_A_BUCKET, MOST_BUCKETS, HEAVY = 250_000, 20_000, 2_000
#: Scans of sorted buckets count as sorted; a union of them is dealt anew before it is grouped (else equal hashes of one-bucket runs stay apart).
SETTINGS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


@contextmanager
def run_settings(spark: SparkSession):
    """SETTINGS while runs are read and written."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Run:
    """What one run owns, (h, n, top) for each of its keys, and the repeats of these keys that later batches brought."""

    def __init__(self, number: int, own: DataFrame):
        self.number, self.own, self.repeats = number, own, []

    def totals(self) -> DataFrame:
        """Its keys with all that has been seen of them, by merge joins of tables in the same buckets."""
        out = self.own
        for i, r in enumerate(self.repeats):
            out = out.join(r.select("h", F.col("n").alias(f"n{i}"), F.col("top").alias(f"top{i}")).hint("merge"), "h", "left")
        some = range(len(self.repeats))
        n = reduce(lambda a, b: a + b, (F.coalesce(f"n{i}", F.lit(0).cast("long")) for i in some), F.col("n"))
        return out.select("h", n.alias("n"), (F.greatest("top", *(f"top{i}" for i in some)) if self.repeats else F.col("top")).alias("top"))


class LineRuns:
    """Levelled sorted runs of keys. A key belongs to the one run whose batch brought it first (or that this run was merged into); what later batches bring of
    it is a repeat of that run, so a key's total is found where the key is owned."""

    def __init__(self, buckets: int, fanout: int = FANOUT):
        self.buckets, self.fanout = buckets, fanout
        self.levels: list[list[Run]] = [[]]
        self.tables: list[DataFrame] = []

    def _runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _save(self, df: DataFrame, tag: str) -> DataFrame:
        with run_settings(df.sparkSession):
            return save_bucketed(df, tag, "h", self.buckets)

    def _kept(self, df: DataFrame, tag: str) -> DataFrame:
        self.tables.append(self._save(df, tag))
        return self.tables[-1]

    def _push(self, run: Run) -> None:
        """Add a run to level 0; merge each level that is full into one run of the next."""
        self.levels[0].append(run)
        k = 0
        while len(self.levels[k]) >= self.fanout:
            old, self.levels[k] = self.levels[k], []
            entries = reduce(DataFrame.unionAll, (r.totals() for r in old))  # no key is owned twice, so nothing is grouped
            merged = self._kept(entries.repartition(self.buckets, "h").sortWithinPartitions("h"), "run")
            k += 1
            if k == len(self.levels):
                self.levels.append([])
            self.levels[k].append(Run(max(r.number for r in old), merged))

    def add(self, lines: DataFrame) -> None:
        """lines: (h, doc_id), one row for each document and key. The batch is joined with each run: keys that none owns become a run, the
        others repeats of their owners."""
        entries = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        entries = entries.repartition(self.buckets, "h").sortWithinPartitions("h")
        runs = self._runs()
        number = 1 + max((r.number for r in runs), default=-1)
        if not runs:
            self._push(Run(number, self._kept(entries, "run")))
            return
        batch = self._save(entries, "batch")
        told = batch
        for r in runs:
            told = told.join(r.own.select("h", F.lit(r.number).alias(f"owner{r.number}")).hint("merge"), "h", "left")
        owner = F.coalesce(*(F.col(f"owner{r.number}") for r in runs), F.lit(number))
        told = self._kept(told.select("h", "n", "top", owner.alias("owner")), "told")
        forget(batch)
        for r in runs:
            r.repeats.append(told.where(F.col("owner") == r.number).drop("owner"))
        self._push(Run(number, told.where(F.col("owner") == number).drop("owner")))

    def hot(self, min_docs: int) -> DataFrame:
        """A saved table (h, n, top) of the keys found in at least min_docs documents."""
        with run_settings(self.tables[0].sparkSession):
            return save(reduce(DataFrame.unionAll, (r.totals().where(F.col("n") >= min_docs) for r in self._runs())), "hot")

    def forget(self) -> None:
        forget(*self.tables)


def _lines(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(batch, doc_id, th, pos, h, first): the lines whose key is long enough; first: the key's first line of its document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.transform(
        F.split(text, "\n"),
        lambda x, i: let(line_key(x), lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.unhex(F.md5(k.cast("binary"))).alias("h"), i.alias("pos")))),
    )
    ordered = let(F.array_sort(F.array_compact(hashed)), lambda a: F.transform(a, lambda s, i: F.struct(s["h"].alias("h"), s["pos"].alias("pos"), F.coalesce(F.get(a, i - 1)["h"] != s["h"], F.lit(True)).alias("first"))))
    th = F.xxhash64("text")
    rows = docs.select("doc_id", th.alias("th"), F.pmod(F.xxhash64("doc_id", th), F.lit(batches)).cast("int").alias("batch"), ordered.alias("lines"))
    return rows.select("doc_id", "th", "batch", F.inline("lines")).select("batch", "doc_id", "th", "pos", "h", "first")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """docs (doc_id, text, ...) with three more columns: n_lines, n_dropped and kept, the text without its dropped lines.
    All columns of docs come back in a struct `row`, so that none can clash."""
    own = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id"), F.col("text"))
    lines = save(_lines(own, min_chars, batches), "lines", by="batch")
    total = lines.count()
    counted = lines.where("first").select("batch", "h", "doc_id", "th")
    twice = None
    if not own.groupBy("doc_id", F.xxhash64("text")).count().where("count > 1").isEmpty():
        counted = twice = save(counted.distinct(), "counted")
    runs = LineRuns(max(1, min(MOST_BUCKETS, total // rows_a_bucket)), fanout)
    for b in range(batches):
        runs.add(counted.where(F.col("batch") == b).select("h", "doc_id"))
    hot = runs.hot(min_docs)
    runs.forget()
    if twice is not None:
        forget(twice)
    often = max(10 * min_docs, -(-total // HEAVY))
    heavy = hot.where(F.col("n") >= often).select("h", F.col("top").alias("t"), F.lit(True).alias("is_heavy"))  # at most HEAVY rows, as total lines are split among them
    told = lines.join(F.broadcast(heavy), "h", "left")
    rest = told.where("is_heavy IS NULL").drop("t").join(hot.where(F.col("n") < often).select("h", F.col("top").alias("t")).hint("merge"), "h")
    drops = told.where("is_heavy").select("doc_id", "th", "pos", "t").unionAll(rest.select("doc_id", "th", "pos", "t"))
    drops = drops.where(~F.col("doc_id").eqNullSafe(F.col("t"))).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drops"))
    drops = save(drops.select(F.col("doc_id").alias("d"), "th", "drops"), "drops")
    forget(lines, hot)
    own = own.withColumn("h", F.xxhash64("text"))
    drops = drops.hint("merge")  # the same plan at every size
    both = own.join(drops, own["doc_id"].eqNullSafe(drops["d"]) & (own["h"] == drops["th"]), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = let(F.split(text, "\n"), lambda a: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("drops")), lambda i: F.get(a, i)), "\n"))
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return both.select(
        "row",
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), text).otherwise(kept).alias("kept"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
), hot AS (
  SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, hot.k IS NOT NULL AND l.doc_id <> hot.top AS gone FROM lines l LEFT JOIN hot ON l.k = hot.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
