import pytest
from pyspark.errors import AnalysisException

from quern.errors import CatalogProblem, QueryProblem, ScriptError, SettingProblem, SyntaxProblem
from quern.job import Job, main, run_script, write_result
from quern.sql import syntax as S
from quern.sql.parser import parse_query, parse_script


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "staff.csv").write_text("name,age,unit,pay\nada,61,1,100.5\nbob,32,2,90\ncyd,47,2,80.25\ndan,58,9,70\neve,33,,60\n")
    (d / "units.csv").write_text("unit_id,label,parent\n1,North,7\n2,South,7\n3,South,8\n")
    (d / "bare.tbl").write_text("1|one\n2|two\n")
    return d


@pytest.fixture
def job(spark, files):
    j = Job(spark)
    j.run(f'CATALOG TABLE staff (TYPE = csv, PATH = "{files}/staff.csv"); catalog table units ("TYPE" = "CSV", "PATH" = "{files}/units.csv", HEADER = YES, PARTITIONS = 2, NROWS = 3);')
    return j


def rows(job, text):
    return sorted([tuple(r) for r in job.query(text).collect()], key=lambda r: tuple((x is None, str(x)) for x in r))


def test_scan_filter_project(job):
    assert rows(job, "select unit * 100, name from staff where age = 32 or age = 61") == [(100, "ada"), (200, "bob")]
    assert job.query("select * from staff").columns == ["NAME", "AGE", "UNIT", "PAY"]
    assert dict(job.query("select age, pay from staff").dtypes) == {"AGE": "bigint", "PAY": "double"}


def test_double_quoted_strings_and_comments(job):
    assert rows(job, "// first\nselect name -- second\nfrom /* third; */ staff where name = \"bob\"") == [("bob",)]
    assert rows(job, "select name from staff where name = 'a\\b'") == []


def test_joins(job):
    assert rows(job, "select s.name, u.unit_id from staff s, units u where s.unit = u.unit_id and u.label = 'South'") == [("bob", 2), ("cyd", 2)]
    assert rows(job, "select name, label from staff left join units on unit = unit_id where age > 50") == [("ada", "North"), ("dan", None)]
    assert rows(job, "select u.label, v.label from units u, units v where u.parent = v.parent and u.unit_id < v.unit_id") == [("North", "South")]


def test_grouping(job):
    got = rows(job, "select unit + 5 as u, sum(age + 10) * 99 / count(age), avg(age) as m, max(name) from staff where unit < 9 group by unit + 5 having sum(age) > 60")
    assert got == [(6, 7029.0, 61.0, "ada"), (7, 4900.5, 39.5, "cyd")]
    assert rows(job, "select count(*), count(unit), count(distinct unit) from staff") == [(5, 4, 3)]


def test_order_top_distinct(job):
    assert [r[0] for r in job.query("select top 2 name from staff order by age desc").collect()] == ["ada", "dan"]
    assert rows(job, "select distinct label from units") == [("North",), ("South",)]


def test_set_operators_lean_left(job):
    text = "select unit_id from units union select parent from units intersect select unit from staff"
    assert rows(job, text) == [(1,), (2,)]
    assert [r[0] for r in job.query("select unit_id as k from units union all select parent from units order by k desc").collect()] == [8, 7, 7, 3, 2, 1]


def test_derived_tables_without_an_alias(job):
    assert rows(job, "select name from (select name, age from staff) where age > 50") == [("ada",), ("dan",)]
    assert rows(job, "select name, label from (select name, unit from staff where age > 60), (select unit_id, label from units) where unit = unit_id") == [("ada", "North")]
    assert rows(job, "select name from staff where unit = 1 union select name from (select name, age from staff) where age < 33") == [("ada",), ("bob",)]


def test_subqueries(job):
    assert rows(job, "select name from staff where age = (select max(age) from staff) and exists (select count(*) from staff where age >= 25)") == [("ada",)]
    assert rows(job, "with old as (select name from staff where age > 50) select * from old") == [("ada",), ("dan",)]
    assert rows(job, "select label from units where unit_id not in (select unit from staff where unit is not null)") == [("South",)]
    assert rows(job, "select name from staff where unit not in (select unit_id from units)") == [("dan",)]


def test_quantifiers(job):
    assert rows(job, "select name from staff where age >= all (select x.age from staff x where x.unit = staff.unit)") == [("ada",), ("cyd",), ("dan",), ("eve",)]
    assert rows(job, "select name from staff where age > all (select age from staff where age > 100)") == [("ada",), ("bob",), ("cyd",), ("dan",), ("eve",)]
    assert rows(job, "select name from staff where unit > all (select unit from staff where name = 'eve')") == []
    assert rows(job, "select name from staff where age < any (select min(age) from staff group by unit)") == [("bob",), ("cyd",), ("dan",), ("eve",)]
    assert rows(job, "select name from staff where unit = any (select unit_id from units union all select parent from units)") == [("ada",), ("bob",), ("cyd",)]
    assert rows(job, "select name from staff where age > all (select age from staff where unit = 2 union select age from staff where unit = 9)") == [("ada",)]


def test_casts_and_dates(job):
    got = rows(job, "select cast('7' as int64) as a, dateadd(dd, 3, cast('2020-02-27' as date32)) as b, datepart(yy, cast('2020-02-27' as date32)) as c, -age as d from staff where age > cast('60' as INT64)")
    assert (got[0][0], str(got[0][1])[:10], got[0][2], got[0][3]) == (7, "2020-03-01", 2020, -61)


def test_numbers_in_group_by_are_constants(job):
    assert rows(job, "select count(*) from staff group by 1") == [(5,)]


@pytest.mark.parametrize(
    "text",
    ["select", "select a from", "select from t", "select a from t where", "select a b from t", "select a from (select b from t) as", "catalog table t ()", "describe t", "select a from t group a", "select 'a from t", "selec a from t", "select a from t limit 3", "select a-1b from t", "select a from t;; x"],
)
def test_syntax_errors(text):
    with pytest.raises(SyntaxProblem):
        parse_script(text)


def test_error_position():
    with pytest.raises(SyntaxProblem) as e:
        parse_script("select a\nfrom t where )")
    assert (e.value.line, e.value.column) == (2, 14)


@pytest.mark.parametrize(
    "text",
    [
        "select 1 from t", "select a.*, b from s.t as a, u b", "select top 5 distinct a from t order by a desc, b",
        "select a from t where not (a = 1 and b <> 2) or c != 3", "select a from t where a is not null and b not like 'x' and c not in (1, 2)",
        "select a from t inner join u on a = b full outer join v on c = d", "select a from (t join u on a = b) right join v on b = c", "select a from (select b from t)", "select * from t u, (select a from t), (select b from t) where a = b",
        "select a from t left join u left join v on b = c on a = b",
        "(select a from t) union all select b from u except select c from v", "with a as (select b from t), c as (select d from a) select * from c",
        "select min(a), max(distinct b), count(*), avg(-c * .5) from t", "select cast(a as float64), f(), g(a, 1) from t",
        "select a from t where a in (select b from u) and exists (select * from u) and a > any (select b from u)", "select case when a = 1 then 2 else 3 end from t", "select a -1 from t", "select a-1 from t",
    ],
)
def test_accepted(text):
    assert isinstance(parse_query(text), S.Query)


def test_precedence():
    e = parse_query("select a from t where a = 1 or b = 2 and not c = 3 + 4 * -5").body.where
    assert e.op == "OR" and e.right.op == "AND" and e.right.right.op == "NOT"
    assert e.right.right.arg.right.op == "+" and e.right.right.arg.right.right.op == "*"


@pytest.mark.parametrize(
    "text, kind",
    [
        ("select a from nowhere", QueryProblem),
        ("select x.name from staff x, units x", QueryProblem),
        ("select q.* from staff", QueryProblem),
        ("select sum(max(age)) from staff", QueryProblem),
        ("select name, count(*) from staff", AnalysisException),
        ("select nothing from staff", AnalysisException),
        ("select cast(name as blob) from staff", QueryProblem),
        ("with r as (select name from r) select * from r", QueryProblem),
        ("catalog table staff (type = csv, path = 'x')", CatalogProblem),
        ("catalog table z (path = 'x')", CatalogProblem),
        ("catalog table z (type = csv)", CatalogProblem),
        ("catalog table z (type = parquet, path = 'x', header = yes)", CatalogProblem),
        ("catalog table z (type = csv, path = 'x', separator = 'ab')", CatalogProblem),
        ("catalog table z (type = csv, path = 'x', partitions = 0)", CatalogProblem),
        ("catalog table z (type = csv, path = 'x', header = perhaps)", CatalogProblem),
        ("catalog table z (type = csv, path = 'x', colour = red)", CatalogProblem),
        ("describe table nowhere", CatalogProblem),
        ("set speed = 3", SettingProblem),
        ("set parallel_degree = 0", SettingProblem),
        ("set trace = 'info'; set trace = 'warn'", SettingProblem),
    ],
)
def test_errors(job, text, kind):
    with pytest.raises(kind):
        job.run(text)[-1].frame.collect()


def test_declared_columns_and_separator(spark, files):
    j = Job(spark)
    j.run(f'CATALOG TABLE b (TYPE = CSV, PATH = "{files}/bare.tbl", HEADER = NO, SEPARATOR = "|", COLUMNS = "k=INT,w=STRING")')
    assert rows(j, "select k + 1, w from b") == [(2, "one"), (3, "two")]
    described = {r["item"]: r["value"] for r in j.run("describe table b")[0].frame.collect()}
    assert described["COLUMN K"] == "bigint" and described["SEPARATOR"] == "|" and described["HEADER"] == "NO"
    with pytest.raises(CatalogProblem):
        j.run(f'CATALOG TABLE c (TYPE = CSV, PATH = "{files}/bare.tbl", COLUMNS = "k=BLOB")')


def test_settings(spark, job):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = job.run("SET PARALLEL_DEGREE = 3; SET PARSE_ONLY = 'true'; select name from staff; set parse_only = 'no'; select name from staff")
        assert job.spark.conf.get("spark.sql.shuffle.partitions") == "3"
        assert spark.conf.get("spark.sql.shuffle.partitions") == before  # other jobs keep theirs
        assert got[4].frame.sparkSession.conf.get("spark.sql.shuffle.partitions") == "3"
        assert got[2].frame is None and "`NAME`" in got[2].sql and got[4].frame is not None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_plans(job):
    r = job.run("select name from staff, units where unit = unit_id and age > 40")[0]
    assert "Physical Plan" in r.explain() and "PushedFilters" in r.explain()
    assert r.dot().startswith("digraph") and "TableRef" in r.dot()


def test_graphs_of_plans(job):
    r = job.run("select label, count(*) from staff, units where unit = unit_id and age > (select min(age) from staff) group by label")[0]
    resolved, logical, physical = (r.dot(x) for x in ("resolved", "logical", "physical"))
    assert "Aggregate" in resolved and "Filter" in resolved and "Join Inner" in logical and "Relation" in logical
    assert "HashAggregate" in physical and "Exchange hashpartitioning" in physical and "Scan csv" in physical and "dashed" in physical
    for text in (resolved, logical, physical):
        assert text.count("{") >= 1 and text.endswith("}") and text.count("->") >= text.count("[label=") - 1
    with pytest.raises(ValueError):
        r.dot("cost")
    parsed = job.run("set parse_only = 'true'; select name from staff")[1]
    assert "TableRef" in parsed.dot()
    with pytest.raises(QueryProblem):
        parsed.dot("physical")


def test_partitions_are_of_one_table(spark, files, tmp_path):
    (tmp_path / "n.csv").write_text("k\n" + "\n".join(map(str, range(2000))))
    j = Job(spark)
    j.run(f'CATALOG TABLE a (TYPE = CSV, PATH = "{tmp_path}/n.csv", PARTITIONS = 5); CATALOG TABLE b (TYPE = CSV, PATH = "{tmp_path}/n.csv")')
    assert j.query("select k from a").rdd.getNumPartitions() >= 5 and j.query("select k from b").rdd.getNumPartitions() == 1
    assert rows(j, "select count(*), sum(a.k) from a, b where a.k = b.k") == [(2000, 1999000)]
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_types_of_csv_come_from_its_first_lines(spark, tmp_path, monkeypatch):
    from quern.sources import catalog

    monkeypatch.setattr(catalog, "SAMPLE_ROWS", 3)
    (tmp_path / "n.csv").write_text("k,w\n1,a\n2,b\n3,c\n4,d\n")
    (tmp_path / "bad.csv").write_text("k,w\n1,a\n2,b\n3,c\nx,d\n")
    (tmp_path / "none.csv").write_text("")
    j = Job(spark)
    j.run(f'CATALOG TABLE n (TYPE = CSV, PATH = "{tmp_path}/n.csv"); CATALOG TABLE bad (TYPE = CSV, PATH = "{tmp_path}/bad.csv")')
    assert dict(j.query("select * from n").dtypes) == {"K": "bigint", "W": "string"} and rows(j, "select sum(k) from n") == [(10,)]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        j.query("select k from bad").collect()
    with pytest.raises(CatalogProblem):
        j.run(f'CATALOG TABLE none (TYPE = CSV, PATH = "{tmp_path}/none.csv")')


@pytest.mark.parametrize("name", ["all_sub_null", "all_aggregate", "anti_not_in", "anti_not_in_left_null", "tpch_q16_like", "any_grouped", "all_equal_not"])
def test_no_row_meets_all_rows_of_a_subquery(spark, name):
    from quern.plans import relational

    df = relational.QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert not [x for x in plan.splitlines() if "LeftAnti, BuildRight, true" in x]  # the null-aware broadcast


def test_not_in_with_nulls_and_without_rows(job):
    assert rows(job, "select name from staff where unit not in (select unit from staff where name = 'eve')") == []
    assert rows(job, "select name from staff where unit not in (select unit from staff where age > 100)") == [("ada",), ("bob",), ("cyd",), ("dan",), ("eve",)]
    assert rows(job, "select name from staff where unit <> all (select unit_id from units) or name = 'ada'") == [("ada",), ("dan",)]
    assert rows(job, "select name from staff s where age not in (select x.age from staff x where x.unit = s.unit and x.name <> s.name)") == [("ada",), ("bob",), ("cyd",), ("dan",), ("eve",)]
    assert rows(job, "select name from staff where not (unit > any (select unit from staff where name = 'eve'))") == []
    assert rows(job, "select name from staff where not (unit > all (select unit from staff where name = 'dan' or name = 'eve'))") == [("ada",), ("bob",), ("cyd",), ("dan",)]


def test_pushdown_reaches_parquet(spark, job, tmp_path):
    job.query("select name, age, pay from staff").write.parquet(str(tmp_path / "p"))
    j = Job(spark)
    j.run(f'CATALOG TABLE p (TYPE = PARQUET, PATH = "{tmp_path}/p")')
    plan = j.run("select name from p where age > 40")[0].explain()
    assert "PushedFilters: [IsNotNull(AGE), GreaterThan(AGE,40)]" in plan
    assert "PAY" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_co_partitioned_steps_share_an_exchange(spark):
    from pyspark.sql import functions as F

    from quern.operators.exchange import co_partitioned_join

    a = spark.range(100).withColumnRenamed("id", "x")
    b = spark.range(100).withColumnRenamed("id", "y")
    df = co_partitioned_join(a, b, ["x"], ["y"], 3).groupBy("x").agg(F.count("y"))
    assert len(df.collect()) == 100
    plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan


@pytest.mark.parametrize("parts", [1, 3, 4])
def test_a_keyed_aggregate_has_one_exchange(spark, parts):
    from pyspark.sql import functions as F

    from quern.operators.exchange import keyed_aggregate

    df = keyed_aggregate(spark.range(100).select((F.col("id") % 10).alias("k")), parts, ["k"], [F.count(F.lit(1)).alias("n")])
    assert df.rdd.getNumPartitions() <= parts and {tuple(r) for r in df.collect()} == {(k, 10) for k in range(10)}
    plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan


def test_command_line(spark, files, tmp_path, capsys):
    script = tmp_path / "s.sql"
    script.write_text(f'CATALOG TABLE staff (TYPE = CSV, PATH = "{files}/staff.csv"); DESCRIBE TABLE staff; SELECT name, name FROM staff;')
    assert main([str(script), str(tmp_path / "out")]) == 0
    assert "ada,ada" in "".join(p.read_text() for p in (tmp_path / "out/query-0").glob("*.csv"))
    script.write_text("select")
    assert main([str(script)]) == 1 and "error" in capsys.readouterr().out
    assert main([]) == 2


def test_write_result(spark, tmp_path):
    write_result(spark.range(3), str(tmp_path / "o"))
    assert sorted("".join(p.read_text() for p in (tmp_path / "o").glob("*.csv")).split()) == ["0", "1", "2"]
    assert issubclass(SyntaxProblem, ScriptError) and callable(run_script)
