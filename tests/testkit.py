"""Helpers shared by the tests of this folder (a module of its own name, so that
no other folder's ``conftest`` can stand in for it)."""

SF = "/root/testdata/sf0.001"


def preds_df(spark, y, s, model="m"):
    rows = [(model, i, i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "model string, machine_id long, end_timestep long, y_true int, y_score double")
