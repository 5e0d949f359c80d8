import random
import re

from quern.operators import reject as J
from quern.plans.data_quality import RAW_EMP, RAW_EMPLOYEES

PLAIN = [("a", "string", None), ("b", "string", None)]


def parse(spark, lines, columns=RAW_EMP):
    df = spark.createDataFrame([(i, x, "v") for i, x in enumerate(lines)], "line_id long, line_text string, v_age string")
    return {r["line_id"]: r.asDict() for r in J.parse_records(df, "line_id", "line_text", columns).collect()}


def test_reasons_and_values(spark):
    lines = {
        "ann,30,5,1.5": None,
        '"Ann ""Bo"" C, D",30,5,.5\r': None,
        "ann, 007 ,NULL, NULL ": None,
        ",,,": None,
        "ann,120,x,12.": None,
        "ann,121,5,1": "value",
        "ann,-1,5,1": "value",
        "ann,3.0,5,1": "value",
        "ann,٣,5,1": "value",
        "ann,3,5,1e3": "value",
        "ann,3,5,.": "value",
        "ann,3,5,1,": "columns",
        "": "columns",
        "ann|3|5|1": "columns",
        '"ann,3,5,1': "quoting",
        'a"n"n,3,5,1': "quoting",
        '"ann" ,3,5,1': "quoting",
        '"a"b"c",3,5,1': "quoting",
        'ann",3,5,1,9': "quoting",
        '""a"",3,5,1': "quoting",
        '"",3,5,1': None,
        '"""",3,5,1': None,
        "\r": "columns",
        "ann,3,5,1\r\r": None,
    }
    got = parse(spark, list(lines))
    assert {x: got[i]["reject_reason"] for i, x in enumerate(lines)} == lines
    first = got[1]
    assert (first["v_name"], first["v_age"], first["v_emp_dept_id"], first["v_salary"]) == ('Ann "Bo" C, D', 30, 5, 0.5)
    assert got[2]["v_age"] == 7 and got[2]["v_salary"] is None
    assert got[4]["v_emp_dept_id"] is None
    assert got[5]["v_name"] is None


def test_values_that_no_check_refuses_but_do_not_fit(spark):
    lines = {
        "bob,30,12x,5": (None, "emp_dept_id"),
        "amy,30,9223372036854775807,5": (2**63 - 1, None),
        "amy,30,-9223372036854775808,5": (-(2**63), None),
        "amy,30,9223372036854775808,5": (None, "emp_dept_id"),
        "amy,30,+00000000000000000000012,5": (12, None),
        "amy,30,-,5": (None, "emp_dept_id"),
        "amy,30,,5": (None, None),
    }
    got = parse(spark, list(lines))
    assert {x: (got[i]["v_emp_dept_id"], got[i]["unfit_columns"]) for i, x in enumerate(lines)} == lines
    assert all(r["reject_reason"] is None for r in got.values())
    both = parse(spark, ["1,A,B,T,2020-13-02,UK,,x"], RAW_EMPLOYEES)[0]
    assert both["unfit_columns"] == "hireDate,reportsTo" and both["reject_reason"] is None


def test_slices_are_bounded_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(J, "SLICE_BYTES", 100)
    lines = pa.array(["x" * n for n in (10, 60, 40, 500, 0, 30)] + [None])
    bounds = list(J._slices(lines))
    assert bounds[0][0] == 0 and bounds[-1][1] == len(lines) and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
    assert max(sum(len(x or "") for x in lines.slice(a, b - a).to_pylist()) for a, b in bounds) <= 600
    index = J.Indexed(lines.slice(1, 3))
    assert (index.end - index.begin).tolist() == [60, 40, 500]


def test_null_empty_and_long_records(spark):
    got = parse(spark, [None, '"' + "x," * 50_000 + '",b', "y" * 100_000 + ",b"], PLAIN)
    assert got[0]["reject_reason"] == "columns"
    assert got[1]["reject_reason"] is None and len(got[1]["v_a"]) == 100_000
    assert got[2]["reject_reason"] is None
    assert parse(spark, [], PLAIN) == {}


def test_line_breaks_are_data(spark):
    got = parse(spark, ['1,A,B,T,2020-01-02,UK,"x\ny, z",', "1,A,B,T,2020-13-02,UK,,7"], RAW_EMPLOYEES)
    assert got[0]["v_notes"] == "x\ny, z" and str(got[0]["v_hireDate"]) == "2020-01-02 00:00:00" and got[0]["v_reportsTo"] is None
    assert got[1]["reject_reason"] is None and got[1]["v_hireDate"] is None and got[1]["v_reportsTo"] == 7


def reason(line, n):
    """One character at a time."""
    line = line[:-1] if line.endswith("\r") else line
    fields, state, ok = 1, "start", True
    for c in line:
        if state == "start":
            state = "quoted" if c == '"' else "start" if c == "," else "plain"
            fields += c == ","
        elif state == "plain":
            ok &= c != '"'
            if c == ",":
                state, fields = "start", fields + 1
        elif state == "quoted":
            state = "closing" if c == '"' else state
        elif state == "closing":
            if c == '"':
                state = "quoted"
            elif c == ",":
                state, fields = "start", fields + 1
            else:
                ok, state = False, "plain"
    ok &= state != "quoted"
    return "quoting" if not ok else "columns" if fields != n else None


def test_random_records_against_a_state_machine(spark):
    rnd = random.Random(1)
    lines = ["".join(rnd.choice('",,"a\n\r') for _ in range(rnd.randrange(9))) for _ in range(4000)]
    got = parse(spark, lines, PLAIN)
    for i, line in enumerate(lines):
        assert got[i]["reject_reason"] == reason(line, 2), line


def test_decimal_pattern():
    import pyarrow as pa

    values = ["1", "1.", ".1", ".", "", "1.1.1", "+1", "1 "]
    want = [bool(re.fullmatch(r"\d+(\.\d*)?|\.\d+", v)) for v in values]
    assert J.unsigned_decimal(pa.array(values, pa.large_utf8())).to_pylist() == want
