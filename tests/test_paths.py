import pytest
from pyspark.sql import functions as F

from kinrank.functions import paths as P

# path -> normalize, basename, stem, extensions, domain (FIXTURES "Names and tokens")
CASES = [
    ("view/search/index.phtml", ["view", "search", "index"], "index", "index", ["phtml"], ["search"]),
    ("view/index/index.phtml", ["view", "index", "index"], "index", "index", ["phtml"], ["index"]),
    ("app/IndexController.php", ["app", "index", "controller"], "indexcontroller", "indexcontroller",
     ["php"], ["index"]),
    ("index.php", ["index"], "index", "index", ["php"], ["index"]),
    ("Controller.php", ["controller"], "controller", "controller", ["php"], []),
    ("tests/.gitignore", ["tests", "gitignore"], ".gitignore", "", ["gitignore"], []),
    (".eslintrc.json", ["eslintrc"], ".eslintrc", "", ["eslintrc", "json"], []),
]


@pytest.mark.parametrize("path,norm,base,stem,exts,domain", CASES)
def test_name_features(spark, path, norm, base, stem, exts, domain):
    df = spark.createDataFrame([(path,)], "path string")
    r = df.select(P.normalize("path").alias("n"), P.basename("path").alias("b"),
                  P.primary_stem("path").alias("s"), P.extension_tokens("path").alias("e"),
                  P.domain_tokens("path").alias("d")).first()
    assert (r.n, r.b, r.s, r.e, r.d) == (norm, base, stem, exts, domain)


def test_tokenize_rules(spark):
    df = spark.createDataFrame([("HTMLParser",), ("user2Name",), ("a_bC-d\\E.f",),
                                ("src/UserController.spec.ts",)], "s string")
    got = [r.t for r in df.select(P.tokenize(F.col("s")).alias("t")).collect()]
    assert got == [["htmlparser"], ["user2name"], ["a", "b", "c", "d", "e", "f"],
                   ["src", "user", "controller", "spec", "ts"]]


def test_language(spark):
    df = spark.createDataFrame([("a.py",), ("b.rs",), ("c.kt",), ("d.cs",), ("e.blade.php",), ("f.PY",),
                                (".py",), ("g.txt",)], "path string")
    got = [r.l for r in df.select(P.language("path").alias("l")).collect()]
    assert got == ["python", "rust", "java", "csharp", "php", "generic", "generic", "generic"]
