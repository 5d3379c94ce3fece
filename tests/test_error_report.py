"""The whole error report against one written by hand."""

import duckdb

from rulewright.plans import queries, tasks
from tests.conftest import DATA

SF = f"{DATA}/sf0.01"


def test_all_lines(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    wrong = duck.execute(f"WITH {tasks.SQL['returns']}, s AS (SELECT row_id, y, quantity, tax, {tasks.RULES_SQL['v0']} AS p FROM returns) SELECT row_id, y, p, quantity, tax FROM s WHERE y <> p").fetchall()
    wrong.sort(key=lambda r: r[0])
    fp = sum(r[1] == 0 for r in wrong)
    want = [(0, f"{len(wrong)} rows are wrong: {fp} FP, {len(wrong) - fp} FN")]
    for i, (row_id, y, p, quantity, tax) in enumerate(wrong[:40], 1):
        want.append((i, f'- id={row_id} kind={"FN" if y else "FP"} y={y} prediction={p} features={{"quantity":{float(quantity)},"tax":{float(tax)}}}'))
    want.append((2**40, f"{len(wrong) - 40} more are left out."))
    assert len(want) == 42
    assert sorted(map(tuple, queries.QUERIES["g3_error_report_lines"](spark, SF).collect())) == want
