import hashlib
import zlib

import pytest

from tidemark.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def way(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        run = i - i % fanout
        out.append((level[run:i], level[i + 1 : run + fanout]))
        i //= fanout
    return out


def brute(rows, fanout=8):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, digest(*map(encoded, r))))
        trees[g] = own, tree([digest(*map(encoded, r)) for r in own], fanout)
    top = tree([trees[g][1][-1][0] for g in langs], fanout)
    out = []
    for at, g in enumerate(langs):
        own, levels = trees[g]
        for i, r in enumerate(own):
            proof = way(levels, i, fanout) + way(top, at, fanout)
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            fold = digest(*map(encoded, r[:4]), encoded(text))
            for before, after in proof:
                fold = digest(*before, fold, *after)
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], digest(*(x for b, a in proof for x in b + a)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def result(spark, tmp_path, rows, extra=""):
    kinds = "doc_id long, source string, lang string, n_chars long, text string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_query_is_the_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*merkle.FIELDS)
    got = sorted((tuple(r) for r in merkle.op12_merkle_manifest(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()])
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_nulls_ties_repeats_empty_and_long_texts(spark, tmp_path):
    rows = [(i, "s", "en", 3, f"Text {i}") for i in range(-5, 70)]
    rows += [(None, None, None, None, None), (7, "s", None, 1, "Ä A"), (7, "s", "en", 1, ""), (7, "s", "en", 1, ""), (8, "s", "zz", 0, None), (9, None, "é", 1, "Z" * 3_000_000), (10, "s", "", 1, "a\nB")]
    assert result(spark, tmp_path, rows) == brute(rows)


def test_empty_table_and_a_single_row(spark, tmp_path):
    assert result(spark, tmp_path / "none", []) == []
    only = [(3, "s", "en", 1, "One")]
    assert result(spark, tmp_path / "one", only) == brute(only)


@pytest.mark.parametrize("fanout, local_levels", [(2, 0), (2, 1), (3, 2), (8, 0), (8, 1)])
def test_rounds_give_the_tree_whatever_the_blocks(spark, fanout, local_levels):
    """Ragged trees of many sizes, some of one block and some of many, with up to seven rounds."""
    sizes = [1, 2, 3, 8, 9, 17, 65, 66]
    rows = [(100 * g + i, "s", f"g{g}", 1, str(i)) for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    found = merkle.manifest(docs, fanout=fanout, local_levels=local_levels).collect()
    got = sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"], digest(*(x for p in r["proof"] for x in p))) for r in found)
    assert got == sorted(x[:5] for x in brute(rows, fanout))


def test_a_changed_field_is_found(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "x", i, "leaf") for i in range(40)], "id long, kind string, size int, leaf string")
    found = merkle.manifest(docs, by="kind", order="id", fields=("id", "size"), received={"size": F.when(F.col("id") == 5, -1).otherwise(F.col("size"))})
    ok = {r["id"]: r["ok"] for r in found.withColumn("ok", merkle.folded(F.coalesce("received", F.col("leaf")), F.col("proof")) == F.col("root")).collect()}
    assert {k for k, v in ok.items() if not v} == {5} and len(ok) == 40
