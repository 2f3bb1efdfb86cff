"""Queries against their SQL on tables that hold what they look for: quotes, and vectors on both sides of the threshold."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from learnspark.llm.queries import ORACLE_SQL, QUERIES


def both(spark, folder, name, **tables):
    """(rows of the query, rows of its SQL) over the tables given."""
    c = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    r = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    return sorted(repr([row[x] for x in columns]) for row in df.collect()), sorted(repr([row[names.index(x)] for x in columns]) for row in r.fetchall())


@pytest.mark.parametrize("seed", range(4))
def test_quotes(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = []
    for c in range(40):
        said: list[str] = []
        for t in range(r.randint(1, 12)):
            lines = [r.choice(["Yes.", "no", "How ARE you?", "a b", "line %d" % r.randint(0, 6), ""]) for _ in range(r.randint(1, 6))]
            if said and r.random() < 0.6:
                source = r.choice(said).split("\n")
                start = r.randrange(len(source))
                part = source[start : start + r.randint(1, 4)]
                mark = r.choice(["> ", ">", "> > ", " > "])
                lines = [mark + x.upper() if r.random() < 0.2 else mark + x for x in part] + lines
            if r.random() < 0.2:
                lines.insert(r.randint(0, len(lines)), "> nobody said this")
            said.append("\n".join(lines))
            rows.append((c, t if r.random() < 0.95 else t - 1, "u", said[-1]))
    rows += [(None, 0, "u", "> x"), (99, None, "u", "> y\nz"), (98, 0, "u", None), (98, 1, "u", "")]
    table = pa.table(list(map(list, zip(*rows))), schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    mine, sql = both(spark, tmp_path, "op1_quote_threads", conversations=table)
    assert mine == sql
    assert sum("'u'" in x for x in mine) == len(rows) and any(", 1, 1," in x or ", 2, 2," in x for x in mine)


def test_vectors_near_the_threshold(spark, tmp_path):
    r = np.random.default_rng(4)
    base = r.normal(size=(120, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    out = list(base)
    for x in base[:80]:
        for cosine in (0.9, 0.9499, 0.9501, 0.97, 1.0):
            y = r.normal(size=24)
            y -= (y @ x) * x
            y /= np.linalg.norm(y)
            out.append((cosine * x + math.sqrt(1 - cosine**2) * y) * r.uniform(0.1, 9))
    rows = [x.astype(np.float32).tolist() for x in out] + [None, [0.0] * 24, [1.0, 2.0]]
    table = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})
    mine, sql = both(spark, tmp_path, "op5_int8_tiles", embeddings=table)
    assert mine == sql and sum("False" in x for x in mine) > 150
