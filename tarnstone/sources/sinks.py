"""Sinks: tables as states listed by numbered pointers, changed by compare-and-set.

Rows are removed by marks beside the folders, applied when they are read and worked in when they are merged.

A table that changes is a folder of Parquet folders beside numbered pointer files. A pointer lists the folders that make
the table up, in order, and notes about it; the one with the highest number counts. What is written aside becomes visible when the next
pointer is created, which one writer alone can do: by a hard link on a local disk, elsewhere by a rename that refuses an
existing name (atomic on HDFS; an object store needs a file system client that makes it so). So a change carries
the number of the state it read to its commit, and where another one came first it is applied again to the newest state: nothing is lost.

Keyed tables are logs: a change appends the rows that it changed, a reader takes the last one of each key, and rows that
don't change aren't written again until their folder is merged. Small folders are merged from the end of the list, a folder when those
behind it have outgrown half of it, so that a table of any number of changes has a number of folders that grows with the logarithm of its size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..schemas import STAMP
from ..shared import delete, materialise

POINTERS = "_pointers"
END = "end"
#: Folders are partitions by this column for Spark, which readers don't see.
IN = "_in"
#: States that readers and slower writers may still be at; the folders of older ones go.
KEPT = 8
#: Folders of a table from which on small ones are merged.
MOST_FOLDERS = 24
#: How often a change is applied to a newer state before it is given up.
TRIES = 50
#: A note's line in a pointer.
NOTE = "#"
#: The note that lists folders of marks: generations of a source below its mark aren't read any more.
REMOVED, REMOVALS = "removed", "source_id string, below int"


class Conflict(EngineError):
    """Another change was committed first."""


class State(NamedTuple):
    """A state of a table: its pointer's number (-1: none), its folders in order, its notes."""

    number: int
    folders: list[str]
    notes: dict[str, str]


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _pointers(spark: SparkSession, path: str) -> list[int]:
    fs, where = _fs(spark, f"{path}/{POINTERS}")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()) if fs.exists(where) else []


def _listed(spark: SparkSession, path: str, number: int) -> State | None:
    """What a pointer says; None if it isn't whole or has gone meanwhile."""
    fs, where = _fs(spark, f"{path}/{POINTERS}/{number:012d}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()
    if lines[-1] != END:
        return None
    notes = dict(x[len(NOTE) :].split("=", 1) for x in lines if x.startswith(NOTE))
    return State(number, [x for x in lines[:-1] if not x.startswith(NOTE)], notes)


def state(spark: SparkSession, path: str) -> State:
    """The state that counts."""
    for number in reversed(_pointers(spark, path)):
        if (found := _listed(spark, path, number)) is not None:
            return found
    return State(-1, [], {})


def folders(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    return state(spark, path)[:2]


def write_aside(rows: DataFrame, path: str, *by: str) -> str:
    """Write a folder that no pointer lists yet; its name."""
    name = f"{IN}={uuid.uuid4().hex}"
    (rows.write.partitionBy(*by) if by else rows.write).parquet(f"{path}/{name}")
    return name


def _create(spark: SparkSession, path: str, number: int, content: str) -> bool:
    """Create a pointer with its whole content, unless there is one of that number."""
    fs, where = _fs(spark, f"{path}/{POINTERS}/{number:012d}")
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTERS}/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(content.encode()))
    out.close()
    local = fs.getUri().getScheme() == "file"
    try:
        if local:
            at = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            spark._jvm.java.nio.file.Files.createLink(at(where), at(aside))
        else:
            kinds = spark._jvm.org.apache.hadoop.fs.Options.Rename
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(fs.makeQualified(aside), fs.makeQualified(where), spark.sparkContext._gateway.new_array(kinds, 0))
    except Exception:
        if not fs.exists(where):
            raise
        return False
    finally:
        fs.delete(aside, False)
    return True


def commit(spark: SparkSession, path: str, seen: int, listed: list[str], notes: dict[str, str] | None = None) -> int:
    """Make ``listed`` the table if state ``seen`` still counts, else raise :class:`Conflict`; the new state's number.

    What only states older than the last KEPT list is deleted.
    """
    numbers = _pointers(spark, path)
    now = state(spark, path)
    content = "\n".join([*listed, *(f"{NOTE}{k}={v}" for k, v in (now.notes if notes is None else notes).items()), END])
    number = max([seen, *numbers]) + 1
    if now.number != seen or not _create(spark, path, number, content):
        raise Conflict("unavailable", f"{path} was changed meanwhile", "store")
    old, kept = numbers[: -KEPT + 1], numbers[-KEPT + 1 :]
    if old:
        every = lambda s: {*s.folders, *filter(None, s.notes.get(REMOVED, "").split(","))}
        held = {x for n in [*kept, number] if (s := _listed(spark, path, n)) for x in every(s)}
        gone = {x for n in old if (s := _listed(spark, path, n)) for x in every(s)} - held
        delete(spark, *(f"{path}/{x}" for x in gone), *(f"{path}/{POINTERS}/{n:012d}" for n in old))
    return number


def read_state(spark: SparkSession, path: str, at: State, schema=None) -> DataFrame | None:
    """The table at a state; of a keyed one, the last row of each key. None if there is none."""
    if not at.folders:
        return None
    reader = spark.read.option("basePath", path)
    if schema is not None:
        typed = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        reader = reader.schema(f"{typed}, {IN} string")
    rows = reader.parquet(*(f"{path}/{x}" for x in at.folders))
    if REMOVED in at.notes:
        rows = _without_removed(rows, spark.read.schema(REMOVALS).parquet(*(f"{path}/{x}" for x in at.notes[REMOVED].split(","))))
    if not at.notes.get("key") or len(at.folders) == 1:
        return rows.drop(IN)
    nth = F.create_map(*(F.lit(x) for i, name in enumerate(at.folders) for x in (name.partition("=")[2], i)))
    columns = [c for c in rows.columns if c != IN]
    last = rows.groupBy(at.notes["key"]).agg(F.max_by(F.struct(*columns), nth[F.col(IN)]).alias("row"))
    return last.select("row.*")


def _without_removed(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of generations that aren't below their source's mark."""
    marks = removed.groupBy(F.col("source_id").alias("_removed")).agg(F.max("below").alias("_below"))
    return rows.join(marks, F.col("source_id") == F.col("_removed"), "left").where(F.col("_below").isNull() | (F.col("generation") >= F.col("_below"))).drop("_removed", "_below")


def read(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The table as it is; None if there is none."""
    at = state(spark, path)
    if at.folders:
        return read_state(spark, path, at, schema)
    fs, where = _fs(spark, path)
    if at.number >= 0 or not fs.exists(where) or fs.exists(_fs(spark, f"{path}/{POINTERS}")[1]):
        return None
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)  # a plain folder, only ever appended to


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    found = read(spark, path, like.schema)
    return spark.createDataFrame([], like.schema) if found is None else found


# --- changes ------------------------------------------------------------------------------------


def attempt(spark: SparkSession, path: str, change: Callable[[State], tuple[list[str], list[str]] | None], notes: Callable[[dict], dict] = dict, conflict: Callable[[], None] | None = None) -> State:
    """Compare-and-set, as often as needed: ``change`` is given the newest state and returns the folders of the next one and which of
    them it wrote, or None for no change. The state that counts then.

    A change that fails because its state's folders went meanwhile is made again, too.
    """
    for _ in range(TRIES):
        seen = state(spark, path)
        try:
            made = change(seen)
        except Exception:
            if state(spark, path).number == seen.number:
                raise
            continue
        if made is None:
            return seen
        try:
            return State(commit(spark, path, seen.number, made[0], notes(seen.notes)), made[0], notes(seen.notes))
        except Conflict:
            delete(spark, *(f"{path}/{x}" for x in made[1]))
            if conflict:
                conflict()
    raise Conflict("unavailable", f"{path} is changed all the time", "store")


def update(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame | None], schema=None) -> State:
    """Replace a table by what ``change`` makes of its newest state; None leaves it."""

    def once(seen: State):
        rows = change(read_state(spark, path, seen, schema))
        if rows is None:
            return None
        name = write_aside(rows, path)
        return [name], [name]

    return attempt(spark, path, once)


def upsert(spark: SparkSession, path: str, key: str, change: Callable[[DataFrame | None], DataFrame | None], schema=None) -> DataFrame | None:
    """Append to a keyed table the rows that ``change`` makes of its newest state; what was appended, None if nothing was.

    Rows are whole rows of the table, one for each key that is new or changed.
    """
    wrote: list[str] = []

    def once(seen: State):
        wrote.clear()
        rows = change(read_state(spark, path, seen, schema))
        if rows is None:
            return None
        name = write_aside(rows, path)
        wrote.append(name)
        if _count(spark, path, name):
            return [*seen.folders, name], [name]
        delete(spark, f"{path}/{name}")
        wrote.clear()
        return None

    attempt(spark, path, once, lambda notes: notes | {"key": key})
    out = spark.read.schema(schema).parquet(f"{path}/{wrote[0]}") if wrote and schema is not None else spark.read.parquet(f"{path}/{wrote[0]}") if wrote else None
    if wrote:
        out = materialise(out, "changed")  # compaction may delete its folder
        compact(spark, path)
    return out


def _count(spark: SparkSession, path: str, name: str) -> int:
    return spark.read.parquet(f"{path}/{name}").count()


def append(rows: DataFrame, path: str, *by: str, once: tuple[str, int] | None = None, numbered: str | None = None) -> int:
    """Append rows; the number of the state that has them.

    ``once``: (stream, batch): a batch that the table's notes say is there already isn't appended again. ``numbered`` is a column that gets
    ids which grow from commit to commit and never repeat; such rows are few, as they are written by one task.
    """
    spark, name = rows.sparkSession, []
    stamp = "" if once is None else f"batch:{once[0]}"

    def change(seen: State):
        if once is not None and int(seen.notes.get(stamp, -1)) >= once[1]:
            return None
        if numbered is not None or not name:
            number = max([seen.number, *_pointers(spark, path)]) + 1
            made = rows if numbered is None else rows.coalesce(1).withColumn(numbered, F.monotonically_increasing_id() + F.lit(number * (1 << 32)))
            name[:] = [write_aside(made, path, *by)]
        return [*seen.folders, *name], name if numbered is not None else []

    noted = (lambda notes: notes) if once is None else lambda notes: notes | {stamp: str(once[1])}
    number = attempt(spark, path, change, noted).number
    compact(spark, path, *by)
    return number


def split_new(rows: DataFrame, existing: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows to insert (one per key) and rows that are no-ops as their key exists."""
    once = rows.dropDuplicates([key])
    return once.join(existing.select(key), key, "left_anti"), once.join(existing.select(key), key, "left_semi")


def insert_ignore(rows: DataFrame, path: str, key: str = "id", finish=None, *by: str, keyed: bool = False) -> dict[str, int]:
    """Append what isn't there yet; how many were inserted and how many were not.

    ``rows`` are made once: they are written aside, and all that follows reads that. ``finish`` turns the new ones into
    the table's rows. If another change is committed meanwhile, the new rows are told apart again. ``keyed``: the table is a keyed one.
    """
    spark = rows.sparkSession
    once = materialise(rows.dropDuplicates([key]), "insert")
    total, counts = once.count(), {}

    def change(seen: State):
        existing = read_state(spark, path, seen)
        new = once if existing is None else once.join(existing.select(key), key, "left_anti").select(*once.columns)
        name = write_aside(new if finish is None else finish(new), path, *by)
        counts["inserted"] = _count(spark, path, name)
        if counts["inserted"] or not seen.folders:
            return [*seen.folders, name], [name]
        delete(spark, f"{path}/{name}")
        return None

    attempt(spark, path, change, lambda notes: notes | {"key": key} if keyed else notes)
    delete(spark, *{f.rpartition("/")[0] for f in once.inputFiles()})
    compact(spark, path, *by)
    return {"inserted": counts["inserted"], "conflict_noops": total - counts["inserted"]}


def swap_pointer(table: DataFrame, path: str, seen: int | None = None) -> None:
    """Replace a table as a whole, if state ``seen`` (the one before ``table`` was computed) still counts. Without it, whatever is there is replaced."""
    spark = table.sparkSession
    name = write_aside(table, path)
    if seen is None:
        attempt(spark, path, lambda _: ([name], []))
    else:
        commit(spark, path, seen, [name])


def _mergeable(sizes: list[int]) -> int:
    """From which folder on a table's folders are merged: each before has over twice the bytes of all behind it."""
    i = len(sizes) - 1
    while i > 0 and sizes[i - 1] <= 2 * sum(sizes[i:]):
        i -= 1
    return i


def compact(spark: SparkSession, path: str, *by: str, most: int = MOST_FOLDERS) -> bool:
    """Merge the small folders at the end of a table with over ``most`` folders; whether that was done.

    If another change comes first, the next one gets to merge. Rows are the same before and after; a keyed table's replaced rows go.
    """
    seen = state(spark, path)
    if len(seen.folders) <= most:
        return False
    sizes = []
    for x in seen.folders:
        fs, where = _fs(spark, f"{path}/{x}")
        sizes.append(fs.getContentSummary(where).getLength())
    i = _mergeable(sizes)
    if i == len(sizes) - 1:
        return False
    rows = read_state(spark, path, seen._replace(folders=seen.folders[i:]))
    name = write_aside(rows.repartition(*by) if by else rows.coalesce(max(1, sum(sizes[i:]) >> 27)), path, *by)
    notes = seen.notes if i else {k: v for k, v in seen.notes.items() if k != REMOVED}  # no folder holds what the marks remove
    try:
        commit(spark, path, seen.number, [*seen.folders[:i], name], notes)
    except Conflict:
        delete(spark, f"{path}/{name}")
        return False
    return True


def sweep(path: str, spark: SparkSession, sources: DataFrame) -> int:
    """Remove the rows of a table (source_id, generation ...) that are older than their source's current_generation; how many went.

    No row is written again: a mark for each source is put beside the folders, readers leave out what it covers, and a later merge drops it.
    """
    at = sources.select(F.col("id").alias("source_id"), F.col("current_generation").cast("int").alias("below")).where("below > 1")
    went = 0

    def change(seen: State):
        nonlocal went
        went, table = 0, read_state(spark, path, seen)
        if table is None:
            return None
        old = materialise(table.select("source_id", "generation").join(at, "source_id").where("generation < below").groupBy(F.col("source_id").cast("string").alias("source_id")).agg(F.max("below").alias("below"), F.count("*").alias("n")), "removed")
        went = old.agg(F.sum("n")).first()[0] or 0
        if not went:
            return None
        name = write_aside(old.select("source_id", "below").coalesce(1), path)
        marks.append(name)
        return seen.folders, [name]

    marks: list[str] = []
    attempt(spark, path, change, lambda notes: notes | {REMOVED: ",".join([*filter(None, notes.get(REMOVED, "").split(",")), marks[-1]])})
    return went


def event_ok(ok: Column, event: Column) -> Column:
    return F.coalesce(ok, event != "failed")


def append_seam_events(events: DataFrame, path: str) -> None:
    """Append what happened at the seams of a check run: run_id, seam, ok, detail; growing ids and instants are given here."""
    append(events.select(F.lit(None).cast("long").alias("id"), "run_id", "seam", "ok", "detail", F.current_timestamp().alias("created_at")), path, numbered="id")


def append_events(events: DataFrame, path: str, once: tuple[str, int] | None = None) -> None:
    append(events.withColumn("ok", event_ok(F.col("ok"), F.col("event"))), path, once=once)


def receipts(results: DataFrame, queries: DataFrame, config: str, origin: str, stamp: dict | None = None, timings: dict[str, float] | None = None) -> DataFrame:
    """One nested row per query, header and lines together, so that they are written together or not at all.

    ``queries``: query_id, query; ``results``: query_id, rank and the lines' columns. A query without results has
    an empty receipt. ``stamp`` says what embedded the query, ``timings`` how many milliseconds each stage of the batch took.
    """
    lines = [c for c in results.columns if c != "query_id"]
    line = F.struct("rank", *(c for c in lines if c != "rank"))
    grouped = results.groupBy("query_id").agg(F.sort_array(F.collect_list(line)).alias("results"))  # k lines at most
    head = queries.join(grouped, "query_id", "left")
    held = F.coalesce("results", F.array().cast(dict(grouped.dtypes)["results"]))
    made = F.lit(None).cast(STAMP) if stamp is None else F.struct(*(F.lit(stamp[k]).cast(t).alias(k) for k, t in (("provider", "string"), ("model", "string"), ("dimensions", "int"))))
    took = F.create_map(*(x for k, v in (timings or {}).items() for x in (F.lit(k), F.lit(float(v))))).cast("map<string,double>")
    id_ = F.sha2(F.concat_ws("|", F.lit(origin), F.lit(config), F.col("query_id").cast("string"), "query"), 256)
    return head.select(id_.alias("id"), "query_id", "query", F.lit(config).alias("config"), F.lit(origin).alias("origin"), made.alias("stamp"), took.alias("stage_timings"), F.size(held).alias("result_count"), held.alias("results"))


def receipt_lines(stored: DataFrame) -> DataFrame:
    return stored.select("id", F.explode("results").alias("r")).select("id", "r.*")
