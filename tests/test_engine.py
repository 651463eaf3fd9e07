"""The engine on the golden corpus, types, NULLs, tables and errors."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightwell import DBNULL, Engine, SqlError, UnsupportedError
from brightwell.errors import InvalidOperationError
from brightwell.sources import systypes
from brightwell.streaming import stream

EXPRESSIONS = {
    "1": 1, "(1)": 1, "(1) + 1": 2, "(1) + (1)": 2, "1 + 1": 2, "1 - 1": 0, "-1": -1, "- 1": -1, "+1": 1, "+ 1": 1, "2 * 2": 4, "2 / 2": 1, "2 / 1": 2,
    "5 % 2": 1, "5 % 3": 2, "5 % 5": 0, "1 & 3": 1, "1 | 3": 3, "1 ^ 3": 2, "1 + 2 * 3": 7, "3 * 2 + 1": 7, "1 - 2 - 3 - 4": -8, "5 + 5 % 3": 7,
    "2 * -1": -2, "7 / 2": 3, "-7 / 2": -3, "-7 % 3": -1, "7 % -3": 1, "4 | 2 & 1": 0, "abs(1)": 1, "ABS(0)": 0, "abs(-1)": 1, "abs(1) + 1": 2,
    "datalength(1)": 4, "DataLength(N'abc')": 6, "dbo.abs(-3)": 3, "null": None, "abs(null)": None, "datalength(null)": None, "1 + null": None, "null & 1": None,
}

WHERE = [
    ("=", 1, 0, 0), ("=", 1, 1, 1), (">", 1, 0, 1), (">", 1, 1, 0), ("<", 0, 1, 1), ("<", 1, 1, 0),
    *[(o, 1, r, n) for o in (">=", "> =", "!<", "! <") for r, n in ((0, 1), (1, 1), (2, 0))],
    *[(o, 1, r, n) for o in ("<=", "< =", "!>", "! >") for r, n in ((0, 0), (1, 1), (2, 1))],
    *[(o, 1, r, n) for o in ("<>", "< >", "!=", "! =") for r, n in ((0, 1), (1, 0))],
]


def rows(engine, text, **parameters):
    return [tuple(r) for r in engine.sql(text, parameters).collect()]


def number_of(engine, text, **parameters):
    with pytest.raises(SqlError) as found:
        engine.connect().create_command(text).execute_scalar() if not parameters else engine.sql(text, parameters).collect()
    return found.value.number


def test_expressions(engine):
    names = [f"c{i}" for i in range(len(EXPRESSIONS))]
    (got,) = rows(engine, "select " + ", ".join(f"{e} as {n}" for e, n in zip(EXPRESSIONS, names)))
    assert dict(zip(EXPRESSIONS, got)) == EXPRESSIONS
    assert {t for n, t in engine.sql("select 7 / 2 as a, 1 & 2 as b, abs(null) as c, null as d, datalength(1) as e").dtypes} == {"int"}


@pytest.mark.parametrize(("operator", "left", "right", "n"), WHERE)
def test_where_constants(engine, operator, left, right, n):
    assert len(engine.sql(f"select 1 as c where {left} {operator} {right}").take(2)) == n


def test_null_modes(spark):
    frame = spark.createDataFrame([(a, b) for a in (None, 1, 2) for b in (None, 1, 2)], "a int, b int")
    lowest = lambda x: -9 if x is None else x
    rules = {
        "=": lambda a, b: a is not None and a == b, "<>": lambda a, b: not (a is not None and a == b), ">": lambda a, b: lowest(a) > lowest(b),
        ">=": lambda a, b: lowest(a) >= lowest(b), "<": lambda a, b: lowest(a) < lowest(b), "<=": lambda a, b: lowest(a) <= lowest(b),
    }
    for mode in ("two_valued", "ansi"):
        engine = Engine(spark, mode)
        engine.register("n", frame)
        for operator, rule in rules.items():
            want = {(a, b) for a in (None, 1, 2) for b in (None, 1, 2) if rule(a, b) and (mode == "two_valued" or None not in (a, b))}
            assert set(rows(engine, f"select a, b from n where a {operator} b")) == want, (mode, operator)
    with pytest.raises(ValueError):
        Engine(spark, "other")


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.recursive(st.integers(0, 20).map(str), lambda e: st.one_of(st.tuples(e, st.sampled_from("+-*/%&|^"), e).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), e.map(lambda x: f"-{x}" if x[0] != "-" else x)), max_leaves=6))
def test_columns_agree_with_constants(engine, expression):
    """An expression over a column of ones, a constant one, and Python's integers agree."""
    import operator as op

    def trunc(a, b):
        return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)

    def python(text):
        from brightwell.plans.parser import parse

        def walk(e):
            if hasattr(e, "left"):
                a, b = walk(e.left), walk(e.right)
                kinds = {"+": op.add, "-": op.sub, "*": op.mul, "/": trunc, "%": lambda x, y: x - y * trunc(x, y), "&": op.and_, "|": op.or_, "^": op.xor}
                return kinds[e.operator](a, b)
            return -walk(e.operand) if hasattr(e, "operand") else e.value

        return walk(parse(f"select {text}")[0].items[0].expression)

    engine.register("ones", engine.spark.range(1).selectExpr("cast(1 as int) as v"))
    try:
        want = python(expression)
    except ZeroDivisionError:
        assert number_of(engine, f"select {expression}") == 8134
        assert number_of(engine, f"select {expression} * v from ones") == 8134
        return
    assert rows(engine, f"select {expression} as a, {expression} + v - v as b from ones") == [(want, want)]
    engine.connect().create_command("create table ints ( v int )").execute_non_query() if "ints" not in engine.catalog.user else None
    assert engine.connect().create_command(f"insert ints values ( {expression} )").execute_non_query() == 1


def test_names(engine):
    def names(text):
        reader = engine.connect().create_command(text).execute_reader()
        return [reader.get_name(i) for i in range(reader.field_count)]

    assert names("select 1") == [""]
    assert names("select 1 c") == names("select 1 as c") == names("select 1 as [c]") == ["c"]
    assert names("select 1 as [c]]d], 2 as [e f]") == ["c]d", "e f"]
    assert names("select 1 + 1, NAME as c, name from systypes") == ["", "c", "name"]
    assert names("select name, name from systypes") == ["name", "name"]
    assert names("select x from ( select 1 as x ) as x") == ["x"]
    assert names("select SysTypes.Name from systypes") == ["Name"]


def test_systypes(engine):
    assert len(rows(engine, "select 1 as c from systypes as s")) == 34
    assert rows(engine, "select name, length from systypes")[0] == ("image", 16)
    frame = engine.sql("select * from systypes")
    got = [tuple(r) for r in frame.collect()]
    sums = {c: sum(r[i] for r in got if r[i] is not None) for i, c in enumerate(frame.columns) if c not in ("name", "printfmt", "collation")}
    assert sums == {"xtype": 4022, "status": 2, "xusertype": 3714, "length": 57345, "xprec": 346, "xscale": 108, "tdefault": 0, "domain": 0, "uid": 136, "reserved": 0, "collationid": 7 * 872468488, "usertype": 312, "variable": 4, "allownulls": 32, "type": 1327, "prec": 41387, "scale": 108}
    assert len({r[0] for r in got}) == 34 and all(r[16] is None for r in got) and sum(r[19] is None for r in got) == 27
    assert len(systypes.COLUMNS) == 20
    assert number_of(engine, "insert systypes values (1)") == 208
    assert rows(engine, "create table SYSTYPES (v int); insert systypes values (3); select v from SysTypes") == [(3,)]


def test_top(engine):
    for n in ("0", "(0)", "@p0", "(@p0)", "(1 - 1)"):
        assert rows(engine, f"select top {n} 1 as c", p0=0) == []
    for n in ("1", "(1)", "@p0", "(@p0)"):
        assert rows(engine, f"select top {n} 1 as c from systypes", p0=1) == [(1,)]
    assert number_of(engine, "select top (null + 1) 1") == 1060
    assert number_of(engine, "select top ('1') 1") == 1060
    assert number_of(engine, "select top (-1) 1") == 127
    assert number_of(engine, "select top (name) 1 from systypes") == 4115
    assert number_of(engine, "select top (1 / 0) 1") == 8134


def test_top_of_many_rows(engine, tmp_path):
    """Each row once and as many as asked for, whichever partition the last of them is in, and no limit, which would bring them to one task."""
    made = engine.spark.range(0, 40_000, 1, 7).select(F.col("id").alias("place"), (F.col("id") % 10).cast("int").alias("v"))
    made.where("place >= 6000 and place < 13000 or place > 20000").write.parquet(str(tmp_path / "t"))
    files = engine.spark.read.parquet(str(tmp_path / "t"))
    shuffled = files.repartition("v").unionAll(files.groupBy("v").agg(F.max("place").alias("place")).select(-F.col("place"), "v"))
    for name, source in (("files", files), ("shuffled", shuffled)):
        engine.register(name, source)
        whole = {r[0] for r in source.collect()}
        for n in (10_001, 17_500, len(whole) - 1, len(whole), 9_223_372_036_854_775_807):
            frame = engine.sql(f"select top (@n) place, v as c from {name}", {"n": n})
            assert "Limit" not in frame._jdf.queryExecution().optimizedPlan().toString()
            got = [r[0] for r in frame.collect()]
            assert len(got) == len(set(got)) == min(n, len(whole)) and set(got) <= whole
        nested = rows(engine, f"select top 11000 place from (select top 20000 place, v from {name} where v <> 4) as d where v > 2")
        assert len(nested) == len(set(nested)) == 11_000 and {abs(r[0]) % 10 for r in nested} == {3, 5, 6, 7, 8, 9}
        assert number_of(engine, f"select top 20000 place / (v - v) as c from {name} where v > -1") == 8134
        assert number_of(engine, f"select top 20000 v from {name} where v / (v - v) = 1") == 8134
    parts = [len(rows(engine, f"select v from (select top 20000 v from files) as d where v {o} 2")) for o in ("<=", ">")]
    assert sum(parts) == 20_000 and all(parts)
    assert rows(engine, "select top 1000000 v from files where v > 99") == [] and rows(engine, "select top 1000000 1 as c") == [(1,)]


def test_top_of_many_rows_of_a_stream(engine):
    engine.register("s", engine.spark.readStream.schema("r_regionkey int, r_name string").parquet("/root/testdata/sf0.001/region.parquet*"))
    with pytest.raises(UnsupportedError):
        stream(engine, "select top 1000000 r_name from s")


def test_tables(engine):
    command = engine.connect().create_command("create table T ( a int, b smallint null, c bit not null )")
    assert command.execute_non_query() == -1
    insert = lambda text: engine.connect().create_command(text).execute_non_query()
    assert insert("insert t values ( 1, -2, 1 ), ( null, null, 0 )") == 2
    assert insert("insert into dbo.T ( C, a ) values ( 7, 3 ) insert t (c) values (0)") == 2
    assert sorted(rows(engine, "select a, b, c from t"), key=str) == sorted([(1, -2, True), (None, None, False), (3, None, True), (None, None, False)], key=str)
    for text, number in {
        "create table t ( v int )": 2714, "create table u ( v intz )": 2715, "create table u ( v int, V bit )": 2705, "insert x values (1)": 208, "insert t (x) values (1)": 207,
        "insert t values (1)": 213, "insert t values (1, 2, 0), (1, 2)": 10709, "insert t values (1, 2, null)": 515, "insert t (a) values (1)": 515, "insert t values (1, 40000, 0)": 220,
        "insert t values (a, 1, 1)": 128, "insert t values (@p, 1, 1)": 137, "insert t (a, a, c) values (1, 1, 1)": 264, "insert t values ('x', 1, 1)": 245,
    }.items():
        assert number_of(engine, text) == number, text
    assert len(rows(engine, "select a from t")) == 4  # a failed statement stores nothing
    assert number_of(engine, "insert t values (1, 1, 1), (2, 2, null)") == 515
    assert len(rows(engine, "select a from t")) == 4
    with pytest.raises(SqlError, match="Column, parameter, or variable #2: Cannot find data type intz."):
        insert("create table w ( a int, b intz )")
    assert number_of(Engine(engine.spark), "select 1 from t") == 208  # engines share nothing


def test_types(engine):
    engine.sql("create table t ( a tinyint, b smallint, c int, d bit ); insert t values ( 200, 300, 70000, 1 ), ( null, null, null, null ); select 1 as c")
    frame = engine.sql("select a, b, c, d, a + b as ab, b * c / c as bc, a / 7 as a7, d & 1 as d1, abs(b - 400) as e, datalength(a) as f, datalength(d) as g, datalength(b) as h from t")
    assert [t for _, t in frame.dtypes] == ["smallint", "smallint", "int", "boolean", "smallint", "int", "int", "int", "int", "int", "int", "int"]
    assert [tuple(r) for r in frame.collect()] == [(200, 300, 70000, True, 500, 300, 28, 1, 100, 1, 1, 2), (None,) * 12]
    assert number_of(engine, "select a + a from t") == 8115
    assert number_of(engine, "select c * c from t") == 8115
    assert number_of(engine, "select c / (c - c) from t") == 8134
    assert number_of(engine, "select c % (c - c) from t") == 8134
    assert number_of(engine, "select d + d from t") == 402
    assert number_of(engine, "select 2147483647 + 1") == 8115
    assert number_of(engine, "insert t (a) values (256)") == 220
    assert rows(engine, "select c from t where a = 200 and d = 1") == [(70000,)]
    assert rows(engine, "select c from t where c = '70000'") == [(70000,)]
    assert number_of(engine, "select c from t where c = 'x'") == 245


def test_strings(engine):
    assert number_of(engine, "select name + name from systypes") == 402
    assert number_of(engine, "select name & 1 from systypes") == 402
    with pytest.raises(SqlError, match=r"The data types sysname and int are incompatible in the '\+' operator."):
        engine.sql("select name + 1 from systypes")
    assert rows(engine, "select name from systypes where name = @p0", p0="IMAGE") == []
    assert rows(engine, "select name from systypes where name = @p0", p0="image") == [("image",)]
    assert len(rows(engine, "select name from systypes where name < 'c' or name is null")) == 3
    with pytest.raises(UnsupportedError):
        engine.sql("select abs(name) from systypes")


def test_resolution(engine):
    assert number_of(engine, "select x from systypes") == 207
    assert number_of(engine, "select x") == 207
    assert number_of(engine, "select t.name from systypes") == 4104
    assert number_of(engine, "select systypes.name from systypes s") == 4104
    assert number_of(engine, "select 1 from nowhere") == 208
    assert number_of(engine, "select frog()") == 195
    assert number_of(engine, "select abs()") == 174
    assert number_of(engine, "select @x") == 137
    assert number_of(engine, "select @@x") == 137
    assert number_of(engine, "select *") == 263
    assert number_of(engine, "select 1 from (select 1) as x") == 8155
    assert number_of(engine, "select 1 from (select 1 as a, 2 as A) as x") == 8156
    with pytest.raises(UnsupportedError):
        engine.sql("select @@spid")
    with pytest.raises(SqlError, match="'frog' is not a recognized built-in function name."):
        engine.sql("select frog()")
    with pytest.raises(SqlError, match="Invalid object name nowhere."):
        engine.sql("select 1 from nowhere")
    engine.sql("create table e (v int); select 1 as c")
    assert number_of(engine, "select nothing from e") == 207  # though it has no rows


def test_parameters(engine, scalar):
    for name in ("p0", "@p0", "P0"):
        assert [scalar(f"select {p}", **{name: 5}) for p in ("@p0", "(@P0)")] == [5, 5]
    assert scalar("select @p", p=None) is DBNULL
    assert scalar("select @p", p="x") == "x"
    assert scalar("select @p", p=True) is True
    assert scalar("select @p * 2", p=1 << 40) == 1 << 41
    assert scalar("select @p", p=1.5) == 1.5
    assert scalar("select @p", p=datetime.datetime(2020, 1, 2)) == datetime.datetime(2020, 1, 2)
    command = engine.connect().create_command("select @a + 1")
    command.parameters.add("a", "7", "tinyint")
    assert command.execute_scalar() == 8
    command.parameters.clear()
    assert len(command.parameters) == 0
    command.parameters.add("a", 300, "TINYINT")
    with pytest.raises(SqlError):
        command.execute_scalar()
    with pytest.raises(UnsupportedError):
        engine.sql("select @a as c", {"a": object()})


def test_version(engine, scalar):
    for text in ("select @@version", "select @@VERSION", "SELECT @@Version"):
        assert scalar(text) == engine.version
    assert Engine(engine.spark, version="x").sql("select @@version as c").first()[0] == "x"


def test_commands(engine):
    connection = engine.connect()
    assert connection.state == "closed"
    with connection as opened:
        assert opened.state == "open"
        command = opened.create_command("select 1")
        assert command.connection is connection and command.text == "select 1" and command.command_type == "text"
        assert command.timeout == 30
        command.timeout = 5
        with pytest.raises(ValueError, match="timeout"):
            command.timeout = -1
        assert command.timeout == 5
        for action in (command.cancel, command.prepare):
            with pytest.raises(NotImplementedError):
                action()
        with pytest.raises(UnsupportedError):
            command.command_type = "table"
    assert connection.state == "closed"
    assert engine.connect().create_command(None).text == ""
    with pytest.raises(InvalidOperationError, match="ExecuteReader: CommandText property has not been initialized"):
        engine.connect().create_command().execute_reader()
    assert not engine.connect().create_command(" ").execute_reader().read()
    for text in (" ", "--", "/* */"):
        assert engine.connect().create_command(text).execute_scalar() is None
    assert engine.connect().create_command("SET NOCOUNT ON; SET IMPLICIT_TRANSACTIONS OFF").execute_non_query() == -1
    assert engine.options == {"nocount": True, "implicit_transactions": False}


def test_reader(engine):
    text = "create table t ( v int ); insert t values ( 5 ); select v, null, 'x' s from t; insert t values ( 6 ) select v from t"
    with engine.connect().create_command(text).execute_reader() as reader:
        assert reader.records_affected == 2
        assert reader.field_count == 3 and reader.get_ordinal("S") == 2
        with pytest.raises(InvalidOperationError):
            reader[0]
        assert reader.read()
        assert (reader[0], reader["V"], reader.get_int32(0), reader.get_string(2)) == (5, 5, 5, "x")
        assert reader[1] is DBNULL and reader.is_null(1) and not DBNULL
        with pytest.raises(TypeError):
            reader.get_int32(2)
        with pytest.raises(TypeError):
            reader.get_string(0)
        with pytest.raises(IndexError):
            reader["nothing"]
        assert not reader.read()
        assert reader.next_result()
        assert sorted(r[0] for r in reader) == [5, 6]
        assert not reader.next_result() and not reader.read()
    with pytest.raises(InvalidOperationError):
        reader.read()


def test_open_reader_keeps_its_rows(engine):
    reader = engine.connect().create_command("create table t ( v int ); insert t values ( 1 ); select v from t").execute_reader()
    engine.connect().create_command("insert t values ( 2 )").execute_non_query()
    assert [r[0] for r in reader] == [1]


def test_transactions(engine):
    connection, other = engine.connect(), engine.connect()
    command = connection.create_command("create table t ( v int ); insert t values ( 1 )")
    command.execute_non_query()
    transaction = connection.begin_transaction()
    assert transaction.connection is connection and command.transaction is None
    command.transaction = transaction
    assert command.transaction is transaction
    for wrong in (other.begin_transaction(), object()):
        with pytest.raises(InvalidOperationError):
            command.transaction = wrong
    connection.create_command("insert t values ( 2 ); create table u ( v int )").execute_non_query()
    transaction.rollback()
    assert rows(engine, "select v from t") == [(1,)]
    assert number_of(engine, "select v from u") == 208
    with connection.begin_transaction():
        connection.create_command("insert t values ( 3 )").execute_non_query()
    assert len(rows(engine, "select v from t")) == 2
    with pytest.raises(InvalidOperationError):
        transaction.commit()


def test_error_metadata(engine):
    with pytest.raises(SqlError) as found:
        engine.sql("select ,")
    error = found.value
    assert (error.number, error.severity, error.state, error.hresult) == (102, 15, 1, 0x80131904 - (1 << 32))
    assert error.source == "Core Microsoft SqlClient Data Provider" and not error.is_transient and error.errors == [error]
    assert len(error.data) == 6 and error.data["HelpLink.EvtID"] == "102" and error.data["HelpLink.LinkId"] == "20476"


def test_many_inserts_are_one_relation(engine):
    engine.connect().create_command("create table t ( v int );" + "".join(f"insert t values ( {i} )" for i in range(200))).execute_non_query()
    plan = engine.sql("select v from t")._jdf.queryExecution().analyzed().toString()
    assert "Union" not in plan and len(rows(engine, "select v from t")) == 200


def test_plans_push_down(engine):
    engine.register_parquet("/root/testdata/sf0.001", "lineitem")
    plan = engine.sql("select l_orderkey, l_linenumber * 2 as c from lineitem where l_linenumber = 3")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan and "EqualTo(l_linenumber,3)" in plan
    assert "Python" not in plan


def test_streams(engine, tmp_path):
    source = engine.spark.readStream.schema("r_regionkey int, r_name string").parquet("/root/testdata/sf0.001/region.parquet*")
    engine.register("s", source)
    frame = stream(engine, "select r_regionkey * 2 as c from s where r_regionkey > 1")
    query = frame.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path)).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r[0] for r in engine.spark.table("streamed").collect()) == [4, 6, 8]
    with pytest.raises(UnsupportedError):
        stream(engine, "select top 1 r_name from s")
    with pytest.raises(UnsupportedError):
        stream(engine, "select 1 as c")
