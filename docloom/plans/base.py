"""Registration of queries, and the casting of the supplied tables that they share.

Documents are texts of `documents`, a block is a line of one, a corpus document is a `source`. The tree is
region > nation > customer with orders as blocks. Each casting has its SQL twin, a WITH clause's part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under `name`, with its SQL where there is one."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


class Tables:
    """The supplied tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def norm_sql(x: str) -> str:
    """The normaliser in SQL, for texts whose only special characters are accented letters."""
    return f"trim(regexp_replace(regexp_replace(regexp_replace(translate(lower(strip_accents({x})), '’‘‐–—“”', '''''---\"\"'), '(?m)^[ \\t]*-[ \\t]+', ' ', 'g'), '-\\s*\\n\\s*', '', 'g'), '[\\s|•·●■►]+', ' ', 'g'))"


def words_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '[a-z0-9]+')"


def lines(t: Tables) -> DataFrame:
    """doc_id, source, lang, seq (from 1), line: the lines of every document that aren't blank."""
    return spread(t.documents.select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("seq", "line")).withColumn("seq", F.col("seq") + 1).filter(tx.trim_spaces(F.col("line")) != "")


LINES = "lines AS (SELECT * FROM (SELECT doc_id, source, lang, CAST(unnest(generate_series(1, len(string_split(text, chr(10))))) AS INT) AS seq, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '')"

# Fixed values of the casting: order priorities as kinds of blocks.
KINDS = {"1-URGENT": "exclusion", "2-HIGH": "guarantee", "3-MEDIUM": "condition", "4-NOT SPECIFIED": "heading", "5-LOW": "paragraph"}


def nodes(t: Tables) -> DataFrame:
    """node_id, parent_id, level, title, key: the world, its regions, nations and customers."""
    world = t.spark.range(1).select(F.lit("w").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"), F.lit("WORLD").alias("title"), F.lit(0).cast("long").alias("key"))

    def part(frame: DataFrame, letter: str, key: str, parent: Column, level: int, title: str) -> DataFrame:
        return frame.select(F.concat(F.lit(letter), key).alias("node_id"), parent.alias("parent_id"), F.lit(level).alias("level"), F.col(title).alias("title"), F.col(key).cast("long").alias("key"))

    return (
        world.unionByName(part(t.region, "r", "r_regionkey", F.lit("w"), 1, "r_name"))
        .unionByName(part(t.nation, "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"), 2, "n_name"))
        .unionByName(part(t.customer, "c", "c_custkey", F.concat(F.lit("n"), "c_nationkey"), 3, "c_name"))
    )


NODES = """nodes AS (
  SELECT 'w' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS level, 'WORLD' AS title, CAST(0 AS BIGINT) AS key
  UNION ALL SELECT 'r' || r_regionkey, 'w', 1, r_name, CAST(r_regionkey AS BIGINT) FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2, n_name, CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 3, c_name, c_custkey FROM customer)"""


def kind_of(priority: str = "o_orderpriority") -> Column:
    out = F.lit(None).cast("string")
    for name, kind in KINDS.items():
        out = F.when(F.col(priority) == name, kind).otherwise(out)
    return out


KIND_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{k}'" for p, k in KINDS.items()) + " END"


def blocks(t: Tables) -> DataFrame:
    """block_id, node_id, ord, kind, confirmed, price: orders under their customer, every tenth under the nation, every fiftieth under the region."""
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    key = F.col("o_orderkey")
    node = F.when(key % 50 == 0, F.concat(F.lit("r"), "n_regionkey")).when(key % 10 == 0, F.concat(F.lit("n"), "c_nationkey")).otherwise(F.concat(F.lit("c"), "o_custkey"))
    after = F.when(key % 20 == 0, 2_000_000_000_000).otherwise(0)  # behind the child nodes
    return t.orders.join(places, F.col("o_custkey") == F.col("c_custkey")).select(key.alias("block_id"), node.alias("node_id"), (key + after).alias("ord"), kind_of().alias("kind"), (F.col("o_orderstatus") != "P").alias("confirmed"), F.col("o_totalprice").alias("price"))


BLOCKS = f"""blocks AS (
  SELECT o_orderkey AS block_id, CASE WHEN o_orderkey % 50 = 0 THEN 'r' || n_regionkey WHEN o_orderkey % 10 = 0 THEN 'n' || c_nationkey ELSE 'c' || o_custkey END AS node_id,
    o_orderkey + CASE WHEN o_orderkey % 20 = 0 THEN 2000000000000 ELSE 0 END AS ord, {KIND_SQL} AS kind, o_orderstatus <> 'P' AS confirmed, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

CLOSURE = """closure AS (
  WITH RECURSIVE up(ancestor, descendant, distance) AS (
    SELECT node_id, node_id, 0 FROM nodes
    UNION ALL SELECT n.parent_id, u.descendant, u.distance + 1 FROM up u JOIN nodes n ON n.node_id = u.ancestor WHERE n.parent_id IS NOT NULL)
  SELECT * FROM up)"""


def line_words(t: Tables, words: Column | None = None) -> DataFrame:
    """doc_id, source, seq, words: the distinct words of every line that has any; or the arrays named instead."""
    found = F.array_distinct(tx.words_of(F.col("line"))) if words is None else words
    # behind a generator no filter on the words is pushed down, which would find them again for each filter
    return lines(t).select("doc_id", "source", "seq", F.explode(F.filter(F.array(found), lambda w: F.size(w) > 0)).alias("words"))


def block_id() -> Column:
    """A line's id as a block: document and line with leading zeros."""
    return F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(":"), F.lpad(F.col("seq").cast("string"), 5, "0"))


def tokens(t: Tables) -> DataFrame:
    """doc_id, source, seq, token, n_tokens: the distinct words of each line."""
    found = F.array_distinct(tx.words_of(F.col("line")))
    # a lambda's variable holds the words once; as two columns they would be found twice
    sized = tx.let(found, lambda w: F.transform(w, lambda x: F.struct(F.size(w).alias("n_tokens"), x.alias("token"))))
    return lines(t).select("doc_id", "source", "seq", F.inline(sized))


TOKENS = f"tokens AS (SELECT doc_id, source, seq, len(found) AS n_tokens, unnest(found) AS token FROM (SELECT doc_id, source, seq, list_distinct({words_sql(norm_sql('line'))}) AS found FROM lines))"
