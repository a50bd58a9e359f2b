"""One query text for two engines: the few spellings in which Spark SQL and the oracle's SQL differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Spark:
    div = "div"

    def raw(self, s: str) -> str:
        return "r'" + s + "'"

    def like(self, x: str, p: str) -> str:
        return f"({x} RLIKE {self.raw(p)})"

    def count(self, x: str, p: str) -> str:
        return f"regexp_count({x}, {self.raw(p)})"

    def replace(self, x: str, p: str, to: str) -> str:
        return f"regexp_replace({x}, {self.raw(p)}, {self.raw(to)})"

    def extract(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.raw(p)}, {group})"

    def extract_all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.raw(p)}, 0)"

    def each(self, x: str, name: str, body: str) -> str:
        return f"transform({x}, {name} -> {body})"

    def keep(self, x: str, name: str, body: str) -> str:
        return f"filter({x}, {name} -> {body})"

    def lines(self) -> str:
        return r"(SELECT doc_id, CAST(i AS BIGINT) AS i, line FROM documents LATERAL VIEW posexplode(split(text, '\n', -1)) t AS i, line)"

    def seconds(self, ts: str) -> str:
        return f"(unix_micros(CAST({ts} AS TIMESTAMP)) div 1000000)"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '{path}')"

    def hex256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def number(self, x: str) -> str:
        return f"TRY_CAST({x} AS DOUBLE)"

    def size(self, x: str) -> str:
        return f"CAST(size({x}) AS BIGINT)"

    def grams(self, x: str) -> str:
        return f"array_distinct(transform(sequence(1, greatest(length({x}) - 1, 1)), k -> substring({x}, k, 2)))"

    def both(self, a: str, b: str) -> str:
        return f"size(array_intersect({a}, {b}))"

    def day(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd')"

    def plus(self, ts: str, n: int, unit: str) -> str:
        return f"({ts} + INTERVAL {n} {unit})"

    def days(self, a: str, b: str) -> str:
        return f"(SELECT explode(sequence(DATE'{a}', DATE'{b}', INTERVAL 1 DAY)) AS d)"

    def join(self, x: str, by: str, order: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order}, {x} AS x))), e -> e.x), '{by}')"

    def values(self, rows: str, names: str) -> str:
        return f"(SELECT * FROM VALUES {rows} AS t({names}))"

    def upto(self, n: str) -> str:
        """1 to n, which is at least 1."""
        return f"sequence(1, {n})"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, '{by}')"

    def rows_of(self, array: str) -> str:
        return f"explode({array})"

    def joined(self, array: str, by: str) -> str:
        return f"array_join({array}, '{by}')"

    def mode(self, x: str) -> str:
        return f"mode({x})"


class Duck(Spark):
    div = "//"

    def raw(self, s: str) -> str:
        return "'" + s.replace("$1", "\\1").replace("$2", "\\2") + "'"

    def like(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.raw(p)})"

    def count(self, x: str, p: str) -> str:
        return f"len(regexp_extract_all({x}, {self.raw(p)}))"

    def replace(self, x: str, p: str, to: str) -> str:
        return f"regexp_replace({x}, {self.raw(p)}, {self.raw(to)}, 'g')"

    def extract_all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.raw(p)})"

    def each(self, x: str, name: str, body: str) -> str:
        return f"list_transform({x}, lambda {name}: {body})"

    def keep(self, x: str, name: str, body: str) -> str:
        return f"list_filter({x}, lambda {name}: {body})"

    def lines(self) -> str:
        return "(SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"

    def seconds(self, ts: str) -> str:
        return f"(epoch_us({ts}) // 1000000)"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '{path}')"

    def hex256(self, x: str) -> str:
        return f"sha256({x})"

    def size(self, x: str) -> str:
        return f"CAST(len({x}) AS BIGINT)"

    def grams(self, x: str) -> str:
        return f"list_distinct(list_transform(range(1, greatest(length({x}) - 1, 1) + 1), lambda k: substring({x}, k, 2)))"

    def both(self, a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))"

    def day(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%d')"

    def days(self, a: str, b: str) -> str:
        return f"(SELECT CAST(unnest(generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 DAY)) AS DATE) AS d)"

    def join(self, x: str, by: str, order: str) -> str:
        return f"string_agg({x}, '{by}' ORDER BY {order})"

    def values(self, rows: str, names: str) -> str:
        return f"(SELECT * FROM (VALUES {rows}) AS t({names}))"

    def upto(self, n: str) -> str:
        return f"range(1, {n} + 1)"

    def split(self, x: str, by: str) -> str:
        return f"string_split({x}, '{by}')"

    def rows_of(self, array: str) -> str:
        return f"unnest({array})"

    def joined(self, array: str, by: str) -> str:
        return f"array_to_string({array}, '{by}')"



def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def run_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of Spark SQL text over the tables that it names, as views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for table in TABLES:
            if table in text:
                read(spark, sf_dir, table).createOrReplaceTempView(table)
        return spark.sql(text)

    return run


class Catalog:
    """Queries by name, with the oracle's SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def both(self, name: str, text: Callable[[Spark], str], oracle: Callable[[Spark], str] | None = None) -> None:
        """The same logical query on either engine; ``oracle`` where the given SQL says something else."""
        self.queries[name], self.oracle[name] = run_sql(text(Spark())), (oracle or text)(Duck())

    def add(self, name: str, query: Callable[[SparkSession, str], DataFrame], oracle: Callable[[Spark], str] | None = None) -> None:
        self.queries[name] = query
        if oracle:
            self.oracle[name] = oracle(Duck())
