from graphloom.operators import plugins


def test_base_names_of_several_terms(spark):
    names = [f"user_service_{i}" for i in range(11)] + [f"load_app_{i}_config" for i in range(11)] + [f"user_{i}" for i in range(5)]
    nodes = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    paths = spark.createDataFrame([("src/user_service.py",), ("app-config.ts",), ("src/user.rs",), ("user_config.rs",)], "relative_path string")
    found = {tuple(r) for r in plugins.high_impact(paths, nodes).collect()}
    assert found == {("src/user_service.py", 11), ("app-config.ts", 11), ("src/user.rs", 16)}
