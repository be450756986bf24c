"""Small tables that the operators' tests share."""

import pathlib
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def helper_names():
    """All names that the operators give to columns, which a table may have, too."""
    import re

    import quernel.llm as llm

    out = set()
    for f in pathlib.Path(llm.__file__).parent.glob("*.py"):
        code = f.read_text()
        out |= set(re.findall(r'(?:alias|withColumn|withColumnRenamed|fresh)\((?:[^"()]*, )?"(\w+)"', code)) | {x.split()[0] for x in ",".join(re.findall(r'"((?:\w+ (?:long|int|string|double|boolean|binary)(?:, )?)+)"', code)).split(",") if x.strip()}
    return sorted(out - {"doc_id", "text", "lang", "source", "n_chars", "quality", "toxic", "embedding"})


HELPERS = helper_names()


def words(rng, n, size=3000):
    return [f"w{int(rng.paretovariate(0.7)) % size}x{rng.randrange(40)}" for _ in range(n)]


def prose(seed, n):
    return " ".join(words(random.Random(seed), n))


def shuffled(spark):
    """Shuffle files of now, with their bytes."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(k) for k in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def odd(spark):
    """Null ids and texts, empty, white, very long and repeated rows, and an extra column of a clashing name."""
    from pyspark.sql import functions as F

    rows = [(1, None), (None, "null id " * 5), (2, ""), (3, " \n\t"), (4, prose(1, 30000)), (5, prose(2, 80)), (5, prose(2, 80)), (None, None), (6, "ü🙂 " * 20)]
    d, names = documents(spark, rows), {}
    for name in {*HELPERS, *(f"c{k}" for k in range(4)), "sid", "size", "part", "block", "slot", "score", "overlap", "node", "label", "h", "blob", "record", "is_toxic", "quality", "_bucket_"}:
        names[name] = F.lit("clash")
    return d.withColumns(names)
