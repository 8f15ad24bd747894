import hashlib

from fleetwright.plans.chains import install_list, restore_choice


def test_install_list(spark):
    found = [
        ("crm", 0, 2), ("mail", 0, 3), ("crm", 1, 1), ("sale_extra", 0, 4), ("l10n_au", 1, 2),
        ("l10n_de", 1, 3), ("base", 1, 5),
    ]
    catalogue = spark.createDataFrame(found, "name string, path_rank int, seq bigint")
    edges = spark.createDataFrame(
        [("crm", "mail"), ("mail", "base"), ("l10n_au", "crm"), ("crm", "gone")], "module string, dep string"
    )
    got = install_list(catalogue, edges, "en_AU,en_US", "^sale_.*").orderBy("ord").collect()
    assert [r["name"] for r in got] == ["base", "mail", "crm", "l10n_au", "web"]


def test_restore_choice(spark):
    names = [("shop_17_1.tar.gz", 1), ("shop_17_2.tar.gz", 9), ("shop_18_3.tar.gz", 10), ("x_17_4.tar.gz", 5)]
    catalogue = spark.createDataFrame(names, "filename string, mtime_s bigint")
    contents = catalogue.selectExpr("filename AS file", "filename AS content")
    good = hashlib.sha256(b"shop_17_2.tar.gz").hexdigest()
    sidecars = spark.createDataFrame([("shop_17_2.tar.gz", good), ("x_17_4.tar.gz", "0")], "file string, recorded_hash string")
    assert tuple(restore_choice(catalogue, contents, sidecars, "17").first()) == ("shop", "17", "shop_17_2.tar.gz", "ok")
    assert restore_choice(catalogue, contents, sidecars, "17", "x").first()["status"] == "mismatch"
    assert restore_choice(catalogue, contents, sidecars, "18", skip_hash=True).first()["status"] == "skipped"
