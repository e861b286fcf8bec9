"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of distinct line keys (128 bits of hash), each with the number of
documents that hold the line and the largest of their ids, in buckets by key that are
sorted by it. A new batch, bucketed alike, merge-anti-joins the runs, which lie where they
are and as they are, and adds a run of the keys that none of them holds. The keys that a
run holds already become counts beside the runs, merged in when runs are compacted or
read. `fan_in` runs of a level are compacted into one of the next, so a key is rewritten
a logarithmic number of times. What repeats is read from the runs. Runs are tables in the
shared folder.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, join_hot_apart, materialize, reading_in_order, release

SPACE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def lines_of(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def row_key() -> Column:
    """With doc_id, tells rows apart by their text; rows that agree in both lose the same lines."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keyed_lines(docs: DataFrame, least: int = 40) -> DataFrame:
    """(doc_id, row, h1, h2, at, first) of all lines with a key of at least `least` code points: at is the line's place, first whether the key is new in its row. Keys are sorted within the row, nothing is shuffled."""
    keys = F.transform(lines_of(), lambda line, i: F.struct(key_of(line).alias("key"), i.alias("at")))
    hashed = F.transform(F.filter(keys, lambda k: F.length(k["key"]) >= least), lambda k: F.struct(F.xxhash64(k["key"]).alias("h1"), F.xxhash64(F.lit(1), k["key"]).alias("h2"), k["at"].alias("at")))
    kept = docs.select("doc_id", row_key().alias("row"), F.sort_array(hashed).alias("k"))
    before = F.concat(F.array(F.lit(None).cast("struct<h1: bigint, h2: bigint, at: int>")), F.slice("k", 1, F.greatest(F.size("k") - 1, F.lit(0))))
    # Rows without keys are left out after the explosion: before it, Spark would compute the keys twice.
    rows = kept.select("doc_id", "row", F.explode(F.arrays_zip(F.col("k").alias("k"), before.alias("before"))).alias("z")).where("z.k is not null")
    again = (F.col("z.k.h1") == F.col("z.before.h1")) & (F.col("z.k.h2") == F.col("z.before.h2"))
    return rows.select("doc_id", "row", "z.k.h1", "z.k.h2", "z.k.at", (~F.coalesce(again, F.lit(False))).alias("first"))


def counted(lines: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, last_doc) of rows of keyed_lines."""
    return lines.where("first").groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


@dataclass
class Run:
    """Keys, and counts of batches that came later and held some of them again."""

    keys: DataFrame
    again: list[DataFrame] = field(default_factory=list)

    def whole(self) -> DataFrame:
        """The keys with all counts, by merge joins in the order of the run."""
        out = self.keys
        for more in self.again:
            more = more.select(*KEY, F.col("n_docs").alias("_n"), F.col("last_doc").alias("_last")).hint("merge")
            out = out.join(more, KEY, "left").select(*KEY, (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "_last").alias("last_doc"))
        return out


class LineRuns:
    """Sorted runs by level; no two hold the same key. Each batch's rows of `keyed_lines` go in once, by `add`.

    buckets: of each run, by default as many as shuffle partitions.
    """

    def __init__(self, spark: SparkSession, fan_in: int = 3, buckets: int | None = None):
        self.spark, self.fan_in, self.buckets = spark, fan_in, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[Run]] = []

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        return bucketed(df, name, KEY, self.buckets)

    def new_only(self, lines: DataFrame) -> DataFrame:
        """The lines of a batch that no run holds: a merge anti-join with each."""
        for run in self.runs():
            lines = lines.join(run.keys.select(*KEY).hint("merge"), KEY, "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Add a batch: its new keys as a run, its other counts to the runs that hold the keys; then compact full levels."""
        with reading_in_order(self.spark):
            self._add(lines)

    def _add(self, lines: DataFrame) -> None:
        batch = self._stored(counted(lines), "line-batch")
        if self.runs():
            new = self._stored(self.new_only(batch), "line-run")
            again = self._stored(batch.join(new.select(*KEY).hint("merge"), KEY, "left_anti"), "line-again")
            release(batch)
            for run in self.runs():
                run.again.append(again)
        else:
            new = batch
        self._put(0, Run(new))

    def _put(self, level: int, run: Run) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            full, self.levels[level] = self.levels[level], []
            # Grouping keeps the runs' buckets together: as all are dealt alike, nothing is shuffled.
            rows = reduce(DataFrame.unionByName, [r.whole() for r in full]).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
            self._put(level + 1, Run(self._stored(rows, f"line-level-{level + 1}")))
            self._drop(full)

    def _drop(self, gone: list[Run]) -> None:
        """Delete runs, and the counts beside them that no other run needs."""
        held = {id(a) for run in self.runs() for a in run.again}
        release(*(run.keys for run in gone), *{id(a): a for run in gone for a in run.again if id(a) not in held}.values())

    def clear(self) -> None:
        """Delete all runs."""
        gone, self.levels = self.runs(), []
        self._drop(gone)

    def held(self, min_docs: int) -> DataFrame:
        """The keys of the runs that at least min_docs rows hold."""
        return reduce(DataFrame.unionByName, [run.whole().where(F.col("n_docs") >= min_docs) for run in self.runs()])


def repeated(docs: DataFrame, least: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """(doc_id, row, drop): the places of the lines that a row loses, for rows that lose any.

    The rows come in `batches` batches, each of which anti-joins the runs and adds its
    own. A line goes if at least min_docs rows of docs hold its key and its document
    isn't the largest id among them. Rows with a null doc_id count, and lose lines that
    others hold.
    """
    runs = LineRuns(docs.sparkSession)
    lines = materialize(keyed_lines(docs, least).withColumn("batch", F.pmod(F.xxhash64("doc_id", "row"), F.lit(batches)).cast("int")), "line-keys", "batch")
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    with reading_in_order(docs.sparkSession):
        often = materialize(runs.held(min_docs), "line-often")
    runs.clear()
    once = join_hot_apart(lines.select("doc_id", "row", *KEY, "at"), often, KEY, "n_docs", lines.count()).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return once.groupBy("doc_id", "row").agg(F.collect_set("at").alias("drop"))


#: A bitmap of ids: so many parts of 32,768 bits, 4 MB in all. More ids than it has bits only mean that more texts are shuffled.
_PARTS, _BITS = 1024, 32_768


def _with_maybe(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with _maybe: false only where no row of gone has the id."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(_PARTS * _BITS))
    part, place = (lambda c: F.floor(bit(c) / _BITS).cast("int")), (lambda c: bit(c) % _BITS)
    maps = gone.select(part("_doc").alias("_part"), place("_doc").alias("_place")).groupBy("_part").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    df = docs.withColumn("_part", part("doc_id")).join(F.broadcast(maps), "_part", "left")
    byte = F.conv(F.hex(F.substr("_bits", (place("doc_id") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = byte.bitwiseAND(F.expr("shiftleft(1, cast(pmod(xxhash64(doc_id), 8) as int))")) != 0
    return df.withColumn("_maybe", F.coalesce(some, F.lit(False))).drop("_part", "_bits")


def deduplicated(docs: DataFrame, least: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """docs with the array columns line_list (all lines of a text) and kept (those that stay).

    A null or empty text is one empty line. Repeated rows of a doc_id count as rows of
    their own towards min_docs and lose the same lines. Only texts whose ids are in the
    bitmap of those that lose lines are shuffled; the others stay where they are.
    """
    gone = materialize(repeated(docs, least, min_docs, batches), "line-drops").withColumnsRenamed({"doc_id": "_doc", "row": "_row"})
    told = _with_maybe(docs, gone)
    whole = told.where("not _maybe").drop("_maybe").withColumn("line_list", lines_of()).withColumn("kept", F.col("line_list"))
    joined = told.where("_maybe").drop("_maybe").join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (row_key() == F.col("_row")), "left").withColumn("line_list", lines_of())
    stay = F.array_except(F.sequence(F.lit(0), F.size("line_list") - 1), "drop")
    cut = joined.withColumn("kept", F.when(F.col("drop").isNull(), F.col("line_list")).otherwise(F.transform(stay, lambda i: F.get("line_list", i)))).drop("drop", "_doc", "_row")
    return whole.unionByName(cut)


def first_seen(spark: SparkSession, batches: list[DataFrame], least: int = 40) -> list[DataFrame]:
    """For batches that arrive one after another: the rows of keyed_lines whose key no earlier batch held."""
    runs, out = LineRuns(spark), []
    for docs in batches:
        lines = materialize(keyed_lines(docs, least), "line-batch")
        with reading_in_order(spark):
            out.append(materialize(runs.new_only(lines), "line-new"))
        runs.add(lines)
    runs.clear()
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated lines dropped from text, n_chars counted anew where lines went. A null text stays null."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_rest")  # whatever their names
    done = deduplicated(docs.select("doc_id", "text", rest))
    changed = F.size("kept") < F.size("line_list")
    text = F.when(changed, F.array_join("kept", "\n")).otherwise(F.col("text"))
    out = {c: F.col("_rest").getField(c) for c in docs.columns if c != "text"} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return done.select(*(out[c].alias(c) for c in docs.columns))
