"""Python workers get the package from the driver, wherever it was started."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from lodestone.operators import ann
from lodestone.sources import models, readers
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rows = spark.range(200).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 3), F.lit(1.0)).alias("vector"))
ann.build(rows, {folder!r} + "/index")
print(ann.search(rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), {folder!r} + "/index", 3).count())
print(readers.scripts(spark, {folder!r} + "/s.sql").count(), readers.descriptions(spark, {folder!r} + "/t.csv").count())
answers = models.extract_lineage(spark.createDataFrame([("SELECT a FROM t",)], "SQL string"), lambda prompts: [("nothing", 1) for _ in prompts])
print(answers.first().method)
"""


def test_from_another_folder(tmp_path):
    (tmp_path / "s.sql").write_text("SELECT 1; SELECT 2;")
    (tmp_path / "t.csv").write_text("original_column_name,column_name,column_description,value_description\na,b,c,d\n")
    code = CODE.format(repo=str(Path(__file__).resolve().parents[1]), folder=str(tmp_path))
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k in ("PATH", "JAVA_HOME", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert done.stdout.split() == ["12", "2", "1", "rule"], done.stderr[-3000:]
