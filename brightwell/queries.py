"""The registered queries: T-SQL text for the engine, and the same in DuckDB's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwell.engine import VERSION, Engine
from brightwell.operators.comparison import ANSI, TWO_VALUED
from brightwell.sources import systypes

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Query:
    text: str
    oracle: str
    parameters: dict[str, object] = field(default_factory=dict)
    mode: str = ANSI

    def tables(self) -> list[str]:
        words = set(re.findall(r"\w+", self.text.lower()))
        return [t for t in TABLES if t in words]

    def engine(self, spark: SparkSession, sf_dir: str) -> Engine:
        engine = Engine(spark, self.mode)
        engine.register_parquet(sf_dir, *self.tables())
        if "from nulls" in self.text:
            nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
            part = lambda n: F.nullif(F.col("n_nationkey") % n, F.lit(0))
            engine.register("nulls", nation.select("n_nationkey", part(4).alias("q"), part(3).alias("t")))
        return engine

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.engine(spark, sf_dir).sql(self.text, self.parameters)


FLAGSHIP = Query(
    "select top (100) l_orderkey, abs(l_linenumber - 4) as d from lineitem where l_linenumber > 3",
    "select l_orderkey, abs(l_linenumber - 4) as d from lineitem where l_linenumber > 3 limit 100",
)

_KEYS = "l_orderkey, l_linenumber"


def _computed(expression: str, oracle: str | None = None) -> Query:
    return Query(f"select {_KEYS}, {expression} as c from lineitem", f"select {_KEYS}, {oracle or expression} as c from lineitem")


def _filtered(predicate: str, oracle: str | None = None, **parameters: object) -> Query:
    return Query(f"select {_KEYS}, l_quantity from lineitem where {predicate}", f"select {_KEYS}, l_quantity from lineitem where {oracle or predicate}", parameters)


_NULLS = "(select n_nationkey, nullif(n_nationkey % 4, 0) as q, nullif(n_nationkey % 3, 0) as t from nation)"


def _null_compared(operator: str, oracle: str, mode: str = TWO_VALUED) -> Query:
    return Query(f"select n_nationkey, q, t from nulls where q {operator} t", f"select n_nationkey, q, t from {_NULLS} where {oracle}", mode=mode)


def _systypes_oracle() -> str:
    values = ", ".join(f"('{r[0]}', {r[1]}, {r[4]})" for r in systypes.rows())
    return f"select name, xtype::smallint as xtype, length::smallint as length from (values {values}) as v(name, xtype, length)"


ALL: dict[str, Query] = {
    "scan_project": Query("select n_nationkey, n_name from nation", "select n_nationkey, n_name from nation"),
    "scan_case_insensitive": Query("SELECT N_NAME FROM NATION", 'select n_name as "N_NAME" from nation'),
    "scan_star": Query("select * from region", "select * from region"),
    "scan_schema_prefix": Query("select r_regionkey, r_name from dbo.region", "select r_regionkey, r_name from region"),
    "alias_as": Query("select n_name as c from nation", "select n_name as c from nation"),
    "alias_bare": Query("select n_name c from nation", "select n_name as c from nation"),
    "alias_bracket": Query("select n_name as [e f] from nation", 'select n_name as "e f" from nation'),
    "alias_escaped_bracket": Query("select n_name as [c]]d] from nation", 'select n_name as "c]d" from nation'),
    "multipart_ref": Query("select nation.n_name from nation", "select n_name from nation"),
    "table_alias": Query("select s.n_name from nation as s", "select n_name from nation"),
    "table_alias_bare": Query("select s.n_name, s.n_nationkey from nation s", "select n_name, n_nationkey from nation"),
    "const_project": Query("select 1 + 1 as c from nation", "select 1 + 1 as c from nation"),
    "one_row": Query("select 1 as c", "select 1 as c"),
    "one_row_multi": Query("select 1 as c1, 2 as c2", "select 1 as c1, 2 as c2"),
    "null_literal": Query("select null as c", "select cast(null as integer) as c"),
    "string_literal": Query("select n_nationkey, 'it''s' as c from nation", "select n_nationkey, 'it''s' as c from nation"),
    "parameter": Query("select n_nationkey, @p0 as c from nation", "select n_nationkey, 7 as c from nation", {"p0": 7}),
    "parameter_case": Query("select n_nationkey + @P0 as c from nation", "select n_nationkey + 7 as c from nation", {"@p0": 7}),
    "derived_table": Query("select x from (select 1 + 1 as x) as d", "select x from (select 1 + 1 as x) as d"),
    "derived_over_table": Query("select k from (select n_nationkey as k from nation) as d", "select k from (select n_nationkey as k from nation) as d"),
    "derived_nested": Query("select d.k + 1 as c from (select k from (select n_nationkey * 2 as k from nation where n_regionkey > 1) as e where k > 4) as d where d.k < 40", "select k + 1 as c from (select n_nationkey * 2 as k from nation where n_regionkey > 1) where k > 4 and k < 40"),
    "add": _computed("l_linenumber + 2"),
    "sub": _computed("l_linenumber - 2"),
    "mul": _computed("l_linenumber * 3"),
    "int_div": _computed("l_linenumber / 2", "l_linenumber // 2"),
    "neg_div": _computed("(0 - l_linenumber) / 2", "(0 - l_linenumber) // 2"),
    "mod": _computed("l_linenumber % 3"),
    "neg_mod": _computed("-l_linenumber % 3", "(0 - l_linenumber) % 3"),
    "bit_and": _computed("l_linenumber & 3"),
    "bit_or": _computed("l_linenumber | 8"),
    "bit_xor": _computed("l_linenumber ^ 3", "xor(l_linenumber, 3)"),
    "flat_bitwise": _computed("l_linenumber | 2 & 1", "(l_linenumber | 2) & 1"),
    "flat_mixed": _computed("l_linenumber + 1 & 6 - 1", "((l_linenumber + 1) & 6) - 1"),
    "unary_minus": _computed("-l_linenumber", "0 - l_linenumber"),
    "unary_plus": _computed("+l_linenumber", "l_linenumber"),
    "unary_binds_tight": _computed("2 * -l_linenumber", "2 * (0 - l_linenumber)"),
    "precedence": _computed("1 + l_linenumber * 3", "1 + (l_linenumber * 3)"),
    "mod_precedence": _computed("5 + l_linenumber % 3", "5 + (l_linenumber % 3)"),
    "paren": _computed("(1 + l_linenumber) * 3"),
    "left_assoc": _computed("10 - l_linenumber - 2 - 1", "((10 - l_linenumber) - 2) - 1"),
    "mixed_types": _computed("l_orderkey * 2 + l_linenumber"),
    "float_arithmetic": _computed("l_quantity * 2 - l_linenumber"),
    "where_eq": _filtered("l_linenumber = 3"),
    "where_ne": _filtered("l_linenumber <> 3"),
    "where_gt": _filtered("l_linenumber > 3"),
    "where_ge": _filtered("l_linenumber >= 3"),
    "where_lt": _filtered("l_linenumber < 3"),
    "where_le": _filtered("l_linenumber <= 3"),
    "where_ne_bang": _filtered("l_linenumber ! = 3", "l_linenumber <> 3"),
    "where_not_gt": _filtered("l_linenumber !> 3", "not (l_linenumber > 3)"),
    "where_not_lt": _filtered("l_linenumber ! < 3", "not (l_linenumber < 3)"),
    "where_const_true": Query("select 1 as c where 1 = 1", "select 1 as c where 1 = 1"),
    "where_const_false": Query("select 1 as c where 1 = 0", "select 1 as c where 1 = 0"),
    "where_param": _filtered("l_linenumber = @p0", "l_linenumber = 3", p0=3),
    "where_string_param": Query("select n_nationkey, n_name from nation where n_name = @p0", "select n_nationkey, n_name from nation where n_name = 'NATION_3'", {"p0": "NATION_3"}),
    "where_string_case": Query("select n_nationkey, n_name from nation where n_name = @p0", "select n_nationkey, n_name from nation where n_name = 'nation_3'", {"p0": "nation_3"}),
    "where_conjunction": _filtered("l_linenumber > 2 and l_quantity < 20 and l_linenumber <> 5"),
    "where_disjunction": _filtered("l_linenumber = 1 or not (l_quantity < 45 or l_linenumber > 4)", "l_linenumber = 1 or not (l_quantity < 45 or l_linenumber > 4)"),
    "where_is_null": Query("select n_nationkey, q from nulls where q is null", f"select n_nationkey, q from {_NULLS} where q is null"),
    "where_is_not_null": Query("select n_nationkey, q from nulls where q is not null and t is null", f"select n_nationkey, q from {_NULLS} where q is not null and t is null"),
    "null_cmp_eq": _null_compared("=", "coalesce(q = t, false)"),
    "null_cmp_ne": _null_compared("<>", "not coalesce(q = t, false)"),
    "null_cmp_gt": _null_compared(">", "q is not null and (t is null or coalesce(q > t, false))"),
    "null_cmp_ge": _null_compared(">=", "t is null or coalesce(q >= t, false)"),
    "null_cmp_lt": _null_compared("<", "t is not null and (q is null or coalesce(q < t, false))"),
    "null_cmp_le": _null_compared("<=", "q is null or coalesce(q <= t, false)"),
    "null_cmp_ansi": _null_compared("<>", "q <> t", ANSI),
    "top_zero": Query("select top 0 n_name from nation", "select n_name from nation limit 0"),
    "top_const": Query("select top (5) 1 as c from lineitem", "select 1 as c from lineitem limit 5"),
    "top_all": Query("select top 1000000000 l_orderkey, l_linenumber from lineitem", "select l_orderkey, l_linenumber from lineitem"),
    "top_where": Query("select top 2 n_name from nation where n_nationkey = 3", "select n_name from nation where n_nationkey = 3 limit 2"),
    "top_param": Query("select top (@p0) 1 as c from nation", "select 1 as c from nation limit 4", {"p0": 4}),
    "top_expression": Query("select top (1 + 2 * 3) 1 as c from nation", "select 1 as c from nation limit 7"),
    "abs": _computed("abs(l_linenumber - 4)"),
    "abs_upper": _computed("ABS(l_linenumber - 4) * -1", "0 - abs(l_linenumber - 4)"),
    "abs_null": Query("select abs(null) as c", "select cast(null as integer) as c"),
    "datalength": _computed("datalength(l_linenumber)", "case when l_linenumber is not null then 4 end"),
    "datalength_null": Query("select datalength(null) as c", "select cast(null as integer) as c"),
    "datalength_nullable": Query("select n_nationkey, datalength(q) as c from nulls", f"select n_nationkey, case when q is not null then 4 end as c from {_NULLS}"),
    "datalength_string": Query("select n_nationkey, datalength(n_name) as c from nation", "select n_nationkey, (2 * length(n_name))::integer as c from nation"),
    "version": Query("select @@version as c", f"select '{VERSION}' as c"),
    "systypes_scan": Query("select name, xtype, length from systypes", _systypes_oracle()),
    "systypes_filter": Query("select s.name as n from systypes as s where s.variable = 1 and length > 256", "select * from (values ('varbinary'), ('varchar'), ('nvarchar')) as v(n)"),
    "create_insert_select": Query("create table t ( v int ); insert t values ( 5 ); select v from t", "select 5 as v"),
    "insert_multi_row": Query("create table t ( v int ) insert into t values ( 1 ), ( 2 ), ( 2 ) select v from t", "select * from (values (1), (2), (2)) as x(v)"),
    "insert_columns": Query("create table t ( a int, b int null, c smallint not null ); insert t ( c, a ) values ( 1, 2 ), ( -3, null ); select a, b, c from t", "select * from (values (2, null::integer, 1::smallint), (null, null, -3)) as x(a, b, c)"),
    "insert_param": Query("create table t ( v int );insert t values ( @p0 ); select T.V as c from t", "select 1 as c", {"p0": 1}),
    "insert_types": Query("create table t ( a tinyint, b bit, c smallint ); insert t values ( 200, 5, 1 - 2 ), ( null, 0, 7 ); select a, b, c, a + c as d, datalength(a) as e from t", "select * from (values (200::smallint, true, -1::smallint, 199::smallint, 1), (null, false, 7, null, null)) as x(a, b, c, d, e)"),
    "batch_set": Query("set nocount on; set implicit_transactions off select 1 as c", "select 1 as c"),
    "comments": Query("--x\r\nselect /* a /* b */ c */ n_nationkey from/**/nation -- end", "select n_nationkey from nation"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(ALL)


def oracles() -> dict[str, str]:
    return {k: q.oracle for k, q in ALL.items()}
