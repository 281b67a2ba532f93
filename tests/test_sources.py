"""File-tree loaders and listing operators on a temporary tree."""

import os
import time

from pyspark.sql import functions as F

from quarry.operators import listing as L
from quarry.operators.extract import assemble_documents
from quarry.sources.files import scan_binary, scan_tree, with_content
from quarry.functions.paths import is_index_text


def _tree(base):
    root = os.path.join(base, f"t{int(time.time() * 1e6)}", ".root")
    files = {
        "a.txt": "alpha",
        "_under.txt": "under score",
        ".hidden.txt": "hidden",
        ".dot/x.txt": "in hidden folder",
        "src7/x.md": "seven",
        "src70/y.md": "seventy",
        "src7/deep/z.py": "deep",
        "img.png": "binary-ish",
        "big.txt": "é" * 10,
    }
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8") as fh:
            fh.write(text)
    return root


def test_scan_tree_and_filters(spark):
    root = _tree(spark.conf.get("spark.checkpoint.dir"))
    lst = scan_tree(spark, root)
    files = {r.path[len(root):] for r in lst.filter(~F.col("is_dir")).collect()}
    assert "/_under.txt" in files and "/.hidden.txt" in files and "/.dot/x.txt" in files
    vis = {r.path[len(root):] for r in L.visible_files(lst, root).collect()}
    assert vis == {"/a.txt", "/_under.txt", "/src7/x.md", "/src70/y.md", "/src7/deep/z.py", "/img.png", "/big.txt"}
    kept = {r.path[len(root):] for r in L.drop_excluded(L.visible_files(lst, root), [root + "/src7/"]).collect()}
    assert kept == {"/a.txt", "/_under.txt", "/src70/y.md", "/img.png", "/big.txt"}
    ex = spark.createDataFrame([(root + "/src7",)], "dir string")
    kept2 = {r.path[len(root):] for r in L.drop_excluded_table(L.visible_files(lst, root), ex).collect()}
    assert kept2 == kept


def test_content_cap_and_documents(spark):
    root = _tree(spark.conf.get("spark.checkpoint.dir"))
    lst = L.visible_files(scan_tree(spark, root), root)
    withc = with_content(lst, is_index_text(F.col("name")), cap=5)
    docs = {r.path[len(root):]: r for r in assemble_documents(withc, cap_bytes=5).collect()}
    assert docs["/a.txt"].content == "alpha"
    assert docs["/img.png"].content == ""  # not an indexed type, still a document
    # 5 bytes of 'é' (2 bytes each): two characters and a cut one.
    assert docs["/big.txt"].content == "éé�"
    assert docs["/_under.txt"].content == "under"


def test_scan_binary_lists_metadata(spark):
    root = _tree(spark.conf.get("spark.checkpoint.dir"))
    lst = scan_binary(spark, root)
    assert "content" not in lst.columns
    paths = {r.path[len(root):] for r in lst.collect()}
    # binaryFile skips names starting with '_' and '.', unlike the tree walk.
    assert "/a.txt" in paths and "/_under.txt" not in paths


def test_changed_and_deleted(spark):
    lst = spark.createDataFrame(
        [("/r/a", "a", False, 1, "2024-01-01 00:00:10"), ("/r/b", "b", False, 1, "2024-01-01 00:00:10"),
         ("/r/c", "c", False, 1, "2024-01-01 00:00:10")],
        "path string, name string, is_dir boolean, size long, mod_time string",
    ).withColumn("mod_time", F.to_timestamp("mod_time"))
    man = spark.createDataFrame(
        [("/r/a", "2024-01-01 00:00:10"), ("/r/b", "2024-01-01 00:00:05"), ("/r/gone", "2024-01-01 00:00:00"),
         ("/other/x", "2024-01-01 00:00:00")],
        "path string, last_indexed string",
    ).withColumn("last_indexed", F.to_timestamp("last_indexed"))
    ch = {r.path: r.reason for r in L.changed_files(lst, man).collect()}
    assert ch == {"/r/b": "changed", "/r/c": "new"}  # equal time is not a change
    assert [r.path for r in L.deleted_files(lst, man, ["/r"]).collect()] == ["/r/gone"]


def test_manifest_json_round_trip(spark):
    from quarry.operators.manifest import manifest_from_kv, manifest_to_kv

    man = spark.createDataFrame(
        [("/r/a", "2024-01-01 00:00:00"), ("/r/b", "2024-01-01 00:00:01.250")], "path string, last_indexed string"
    ).withColumn("last_indexed", F.to_timestamp("last_indexed"))
    kv = manifest_to_kv(man)
    vals = {r.key: r.value for r in kv.collect()}
    assert vals == {"/r/a": '{"last_indexed":"2024-01-01T00:00:00Z"}', "/r/b": '{"last_indexed":"2024-01-01T00:00:01.25Z"}'}
    extra = spark.createDataFrame([("", "/x", "{}"), ("files", "", "{}"), ("", "/y", "{}")], "bucket string, key string, value string")
    back = manifest_from_kv(kv.unionByName(extra))
    assert sorted((r.path, str(r.last_indexed)) for r in back.collect()) == sorted(
        (r.path, str(r.last_indexed)) for r in man.collect()
    )


def test_change_set_equals_separate_operators(spark):
    from quarry.sources import corpus as C

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        return
    files = C.files_listing(spark, sf)
    man = C.derived_manifest(files)
    cs = L.change_set(files, man, C.CORPUS_ROOT, C.CORPUS_EXCLUDES)
    got = {(r.path, r.status) for r in cs.select("path", "status").collect()}
    vis = L.drop_excluded(L.visible_files(files, C.CORPUS_ROOT), C.CORPUS_EXCLUDES)
    want = {(r.path, r.reason) for r in L.changed_files(vis, man).select("path", "reason").collect()}
    want |= {(r.path, "deleted") for r in L.deleted_files(files, man, [C.CORPUS_ROOT]).collect()}
    assert got == want and len(got) > 20
