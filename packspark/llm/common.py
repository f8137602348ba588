"""What several operators of this subpackage share."""

from __future__ import annotations

import atexit
import functools
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the ASCII blanks, as the contracts state them.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent (tests on one machine) a local folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/packspark-shared"
    return f"{base.rstrip('/')}/packspark/{spark.sparkContext.applicationId}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path for a table or files in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            remove_path(spark, path)

    atexit.register(drop)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete tables of stash() that nothing will read again."""
    for df in stashed:
        remove_path(df.sparkSession, df.stash_path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, before the
    driver happens to collect its garbage, and give freed native memory back to the system (planning
    and compiling many stages leaves the allocator's arenas full of holes). JVMs without that
    command only collect their garbage."""
    gc.collect()
    sc = spark.sparkContext
    jvm = sc._jvm
    jvm.System.gc()
    # By the public interface: the server's own class is not open to reflection.
    server, kind = jvm.java.lang.Class.forName("javax.management.MBeanServer"), jvm.java.lang.Class
    name = kind.forName("javax.management.ObjectName")
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()

    def call(method: str, types: list, *args: object) -> object:
        kinds, values = sc._gateway.new_array(kind, len(types)), sc._gateway.new_array(jvm.java.lang.Object, len(args))
        for i, (t, x) in enumerate(zip(types, args, strict=True)):
            kinds[i], values[i] = t, x
        return server.getMethod(method, kinds).invoke(beans, values)

    if call("isRegistered", [name], commands) and any(x.getName() == "systemTrimNativeHeap" for x in call("getMBeanInfo", [name], commands).getOperations()):
        array = lambda of: kind.forName(f"[L{of};")
        call("invoke", [name, kind.forName("java.lang.String"), array("java.lang.Object"), array("java.lang.String")], commands, "systemTrimNativeHeap", None, None)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df is called so: helper columns
    must not hide a caller's (Spark's names ignore case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of one key that a join leaves in one place, into how many places it deals a key at most, and
#: how many keys are dealt so (their list is broadcast).
KEY_ROWS, MOST_PLACES, MOST_KEYS = 5_000, 1_000, 1_000


def places(rows: Column) -> Column:
    """Among how many places the rows of one key are dealt in a join."""
    return F.least(F.lit(MOST_PLACES), F.ceil(rows / KEY_ROWS)).cast("int")


def every_place(need: Column) -> Column:
    """All places of a key, for the side of a join that has few rows a key."""
    return F.explode(F.sequence(F.lit(0), need - 1))


def one_place(need: Column, *by: Column | str) -> Column:
    return F.pmod(F.xxhash64(*by), need).cast("int")


def join_facts(rows: DataFrame, facts: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """rows joined with facts, which has one row a key and in _rows how many of ``rows`` have it.

    Keys with more than KEY_ROWS rows, and more than a share of 1 / MOST_KEYS of all, are dealt to
    several places each, whatever adaptive execution does; there are at most MOST_KEYS of them, so
    their list is broadcast. Rows without a key are dealt likewise. facts should be a stored table:
    it is read three times.
    """
    total = facts.agg(F.sum("_rows")).first()[0] or 0
    need = F.when(F.col("_rows") > max(KEY_ROWS, total // MOST_KEYS), places(F.col("_rows"))).otherwise(1)
    keys = [f"_hot_{k}" for k in key]
    hot = facts.filter(need > 1).select(*[F.col(k).alias(h) for k, h in zip(key, keys, strict=True)], need.alias("_need"))
    same, none = F.lit(True), F.lit(False)
    for k, h in zip(key, keys, strict=True):
        same, none = same & (F.col(k) == F.col(h)), none | F.col(k).isNull()
    place = F.when(none, one_place(F.lit(MOST_PLACES), *rows.columns)).otherwise(F.coalesce(one_place(F.col("_need"), *rows.columns), F.lit(0)))
    dealt = rows.join(F.broadcast(hot), same, "left").withColumn("_place", place).drop("_need", *keys)
    return dealt.join(facts.withColumn("_place", every_place(need)).drop("_rows"), [*key, "_place"], how).drop("_place")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda, Spark would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(*cols: Column | str) -> list[Column]:
    """Two 64-bit hashes of the columns as a key of 128 bits that is never null."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("second"), *cols).alias("k2")]


def fold(col: Column | str, n: int) -> Column:
    """crc32 of the value as text, modulo n (null ids count as the empty text)."""
    return F.crc32(F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("")).cast("binary")) % n


def arrow_udf(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas UDF of that DDL type, made when first applied: importing needs no session."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def apply(*cols: Column | str) -> Column:
            return F.pandas_udf(f, ddl)(*cols)

        return apply

    return wrap
