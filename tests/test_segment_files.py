from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wayfind.operators import segments


def test_row_groups_have_few_blocks(spark, tmp_path):
    index = segments.Index(spark, str(tmp_path / "index"), "id", {"t": F.concat(F.lit("word"), F.col("id") % 5)})
    index.create(spark.range(7000).coalesce(1))
    files = [pq.ParquetFile(f).metadata for f in Path(tmp_path).rglob("blocks/*.parquet")]
    assert sum(m.num_rows for m in files) == 7
    assert all(m.row_group(g).num_rows <= segments.GROUP_BLOCKS for m in files for g in range(m.num_row_groups))
