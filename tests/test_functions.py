"""Column expressions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from stowline.functions.content import UnsupportedDigest, digest, head_digest, head_length, hydration, normal_id
from stowline.functions.paths import basename, dirname, escape_reason, extension
from stowline.functions.redaction import redact_map
from stowline.functions.rules import Policy, collection_of, compile_match, example_rules, with_match_inputs
from stowline.functions.units import GIB, KIB, MIB, format_bytes


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_public_digest_vectors(spark):
    df = spark.createDataFrame([(b"abc",)], "v binary")
    row = df.select(*[digest(F.col("v"), a).alias(a) for a in ("md5", "sha1", "sha256")]).first()
    assert row["md5"] == "900150983cd24fb0d6963f7d28e17f72"
    assert row["sha1"] == "a9993e364706816aba3e25717850c26c9cd0d89d"
    assert row["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


@pytest.mark.parametrize("algo", ["quickxor", "crc32"])
def test_unknown_digest_raises(spark, algo):
    with pytest.raises(UnsupportedDigest):
        digest(F.lit("x"), algo)


def test_head_probe_ignores_what_lies_behind_it(spark):
    body = bytearray(200 * 1024)
    late, early = bytearray(body), bytearray(body)
    late[100 * 1024] = 1
    early[10] = 1
    rows = [(0, bytes(body)), (1, bytes(late)), (2, bytes(early)), (3, b"abc")]
    df = spark.createDataFrame(rows, "i int, v binary").select("i", head_digest(F.col("v")).alias("h"), head_length(F.col("v")).alias("n"))
    got = {r["i"]: (r["h"], r["n"]) for r in df.collect()}
    assert got[0] == got[1] and got[0][0] != got[2][0]
    assert got[0][1] == 65536 and got[3][1] == 3 and len(got[3][0]) == 128


def test_content_id_parsing(spark):
    good = "b3:" + "aB" * 32
    bad = ["", "b3:", "b3:" + "a" * 63, "b3:" + "a" * 65, "b3:" + "g" * 64, "a" * 64, "B3:" + "a" * 64, None]
    assert column(spark, [good, *bad], normal_id) == [good.lower()] + [None] * len(bad)


def test_byte_format(spark):
    sizes = [0, 1023, KIB, MIB * 3 // 2, 1610612736, 5 * GIB, 2048 * GIB, GIB + GIB // 8, None, MIB - 1]
    want = ["0 B", "1023 B", "1.00 KiB", "1.50 MiB", "1.50 GiB", "5.00 GiB", "2048.00 GiB", "1.12 GiB", None, "1024.00 KiB"]
    assert column(spark, sizes, format_bytes, "bigint") == want


def test_path_parts(spark):
    paths = ["D:\\Videos\\a.MP4", "/x/y", "plain", "/a/.hidden", "c\\d/e.tar.gz"]
    assert column(spark, paths, basename) == ["a.MP4", "y", "plain", ".hidden", "e.tar.gz"]
    assert column(spark, paths, dirname) == ["D:/Videos", "/x", "", "/a", "c/d"]
    assert column(spark, paths, extension) == ["mp4", "", "", "hidden", "gz"]


def test_paths_that_leave_the_root(spark):
    bad = ["../up.bin", "in/deep/../../../up.bin", "..", "notes.doc:stream", "/var/log/x", "E:notes.doc",
           "D:\\rootless\\x", "D:\\root\\a:b", None]
    good = ["clip.mp4", "a/b/c.mp4", "a\\b", "D:\\root\\x.mp4", "d:/ROOT/y", "..hidden", "a..b"]
    reasons = column(spark, bad + good, lambda p: escape_reason(p, F.lit("D:\\root")))
    assert all(r is not None for r in reasons[:len(bad)])
    assert reasons[len(bad):] == [None] * len(good)


def test_hydration(spark):
    rows = [(0x00400000, 0, "volume"), (0x00040000, None, "volume"), (32, 0x9000001A, "volume"), (32, 0x9000F01A, "volume"),
            (32, 0x9000001C, "volume"), (None, None, "volume"), (0x00400000, 0, "cloud")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a int, t bigint, k string")
    got = [r["h"] for r in df.select("i", hydration(F.col("a"), F.col("t"), F.col("k")).alias("h")).orderBy("i").collect()]
    assert got == ["placeholder"] * 4 + ["local_full"] * 2 + ["cloud_native"]


def test_redaction(spark):
    fields = {
        "token": "one", "access_token": "x", "Authorization": "y", "client_secret": "z", "MY_API_KEY": "k", "password": "p",
        "session_uri": "https://h/dl?sig=SECRET&x=1", "url": "https://h/plain", "HREF": "a?b?c", "plan_id": "plan-11aa",
        "msg": "Authorization: Bearer one to api", "two": "Bearer one Bearer two", "quoted": "'Bearer abc'", "note": "https://h/?q=1",
        "empty": "Bearer  x", "none": None,
    }
    got = spark.createDataFrame([(fields,)], "f map<string,string>").select(redact_map(F.col("f")).alias("f")).first()["f"]
    masked = {"token", "access_token", "Authorization", "client_secret", "MY_API_KEY", "password"}
    assert {k for k, v in got.items() if v == "[REDACTED]"} == masked
    assert got["session_uri"] == "https://h/dl?[REDACTED]" and got["url"] == "https://h/plain" and got["HREF"] == "a?[REDACTED]"
    assert got["msg"] == "Authorization: Bearer [REDACTED] to api" and got["two"] == "Bearer [REDACTED] Bearer [REDACTED]"
    assert got["quoted"] == "'Bearer [REDACTED]'" and got["note"] == "https://h/?q=1" and got["plan_id"] == "plan-11aa"
    assert got["empty"] == "Bearer [REDACTED] x" and got["none"] is None


def test_first_match_and_literal_substrings(spark):
    rows = [
        ("D:\\OldClips\\old.mp4", None, "Archives"), ("/Archives/cutscene.mp4", "video/mp4", "Archives"),
        ("D:\\Videos\\Captures\\boss.mp4", None, "Gaming Clips"), ("/clips/x", "VIDEO/x", "Gaming Clips"), ("/a/b.ZIP", None, "Archives"),
        ("/Docs/r.pdf", None, "Documents"), ("/MyArchive/x.bin", None, "default"), ("/misc/none", None, "default"), (None, None, "default"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, path string, mime string, want string")
    got = with_match_inputs(df).select("i", "want", collection_of(example_rules()).alias("got")).orderBy("i").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_archive_needle_does_not_match_archives(spark):
    df = spark.createDataFrame([("/Archives/x.mp4", None)], "path string, mime string")
    assert with_match_inputs(df).select(compile_match({"path_contains": "/Archive/"}).alias("m")).first()["m"] is False


def test_missing_mime_is_false_not_null(spark):
    df = spark.createDataFrame([(None, None)], "path string, mime string")
    tests = [{"mime_prefix": "video/"}, {"not": {"mime_prefix": "video/"}}, {"all": []}, {"any": []}, {"extension": ["mp4"]}, {"always": True}]
    got = with_match_inputs(df).select(*[compile_match(m).alias(str(i)) for i, m in enumerate(tests)]).first()
    assert list(got) == [False, True, True, False, False, True]


@pytest.mark.parametrize("bad", [{"keep_local": "maybe"}, {"min_replicas": 0}, {"cloud_choice": "cheapest"}])
def test_policy_values_are_checked(bad):
    with pytest.raises(ValueError):
        Policy(**bad)


def test_unknown_match_test_is_an_error(spark):
    with pytest.raises(ValueError):
        compile_match({"regex": "x"})
