"""Compare Spark column types of every query with the types of its DuckDB oracle (sf0.001)."""
import sys
import os; sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from coheral.session import get_spark
import __spark_entry__ as E
from tests.oracle_check import duck
spark = get_spark(cpus=8)
con = duck('/root/testdata/sf0.001')
M = {'bigint': 'BIGINT', 'int': 'INTEGER', 'double': 'DOUBLE', 'string': 'VARCHAR', 'boolean': 'BOOLEAN', 'float': 'FLOAT'}
qs, sq = E.queries(), E.oracle_sql()
bad = 0
for n, sql in sq.items():
    df = qs[n](spark, '/root/testdata/sf0.001')
    st = {c: M.get(t, t) for c, t in df.dtypes}
    rel = con.sql(sql)
    dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    diff = {c: (st[c], dt.get(c)) for c in st if st[c] != dt.get(c)}
    if diff:
        bad += 1
        print(n, diff)
print("mismatching queries:", bad)
