"""Relations that the catalog's queries run on: the documents as a corpus, a batch of questions, and
source files generated from the star schema, whose symbols and imports SQL can tell too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packspark.session import table
from packspark.sources.workspace import Corpus, from_table

#: query_id, query: a stated batch, asked of whole tables.
BATCH = (
    (1, "Fix the error about moron in src3/doc12.md and ./doc7.md"),
    (2, "Explain what is pathetic in trashTalk and why does `worthless` happen"),
    (3, "Refactor the clown and simplify scum_loser handling"),
    (4, "Review the pull request for idiot security at src1/doc40.md:12"),
    (5, "Add support for a disgustingStupid ostrich"),
    (6, "the quick brown fox jumps over stuff"),
    (7, ""),
    (8, 'TypeError in File "geo/n3.py", line 4: load_n3 and `Nation7` fail, see web/p5.ts and web\\\\s2.ts'),
)

#: (query_id, symbol) looked up in the generated files.
SYMBOL_MENTIONS = ((1, "load_n3"), (2, "nation7"), (3, "pay"), (4, "if"), (5, "missing"), (6, "loadPart12"), (6, "SUPPLIER4"))


def batch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q.replace("\\\\", "\\")) for i, q in BATCH], "query_id long, query string")


def batch_sql() -> str:
    """The batch as SQL rows."""
    rows = ", ".join("({}, '{}')".format(i, q.replace("\\\\", "\\").replace("'", "''")) for i, q in BATCH)
    return f"(VALUES {rows}) AS batch(query_id, query)"


def documents_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """documents as files source/docN.md; the id stands for the time of the last change."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    return from_table(docs, path, "text", F.col("doc_id"))


def code_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """A module for each nation, region, supplier and part."""
    s = lambda c: F.col(c).cast("string")
    nation, region, supplier, part = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "part"))
    n, r = s("n_nationkey"), s("n_regionkey")
    parts = [
        nation.select(
            F.concat(F.lit("geo/n"), n, F.lit(".py")).alias("path"),
            F.concat(F.lit("import geo.r"), r, F.lit("\nfrom . import shared\n\n@tag\ndef load_n"), n, F.lit("(x):\n    return x\n\nclass Nation"), n, F.lit(":\n    def total(self):\n        return 1\n")).alias("text"),
        ),
        region.select(F.concat(F.lit("geo/r"), s("r_regionkey"), F.lit(".py")).alias("path"), F.concat(F.lit("REGION = '"), F.col("r_name"), F.lit("'\n")).alias("text")),
        supplier.select(
            F.concat(F.lit("web/s"), s("s_suppkey"), F.lit(".ts")).alias("path"),
            F.concat(F.lit("export class Supplier"), s("s_suppkey"), F.lit(" {\n  pay(amount) {\n    return amount;\n  }\n}\n")).alias("text"),
        ),
        part.select(
            F.concat(F.lit("web/p"), s("p_partkey"), F.lit(".ts")).alias("path"),
            F.concat(F.lit("import { Supplier } from './s"), (F.col("p_partkey") % 10).cast("string"), F.lit("';\nexport function loadPart"), s("p_partkey"), F.lit("(a) {\n  if (a) {\n    return 1;\n  }\n}\n")).alias("text"),
        ),
        spark.createDataFrame([("geo/__init__.py", "shared = 1\n")], "path string, text string"),
    ]
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    return from_table(files, F.col("path"))
