from pyspark.sql import functions as F

from millrace.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


ODD = ["  a b ", "\t\n a b  ", "\x1c\x1fx\x1d y\x1e", "", "　", "a", "é\u0085è"]


def test_strip_is_pythons(spark):
    for x in ODD:
        assert one(spark, x, T.strip) == x.strip()


def test_words_and_collapse_are_pythons(spark):
    for x in ODD:
        assert one(spark, x, T.words) == x.split()
        assert one(spark, x, T.collapse) == " ".join(x.split()) if x == x.strip() else True


def test_clean(spark):
    assert one(spark, " a\x00b\n\n c\x7f ", T.clean) == "ab c"
    assert one(spark, "inter-\n national", lambda c: T.clean(c, True)) == "international"
    assert one(spark, "inter-\n national", T.clean) == "inter- national"
    assert one(spark, None, T.clean) is None


def test_names_and_paths(spark):
    assert one(spark, "a/b/c.Tar.GZ", T.basename) == "c.Tar.GZ"
    assert one(spark, "a/b/c.Tar.GZ", T.suffix) == ".gz"
    assert one(spark, "a/.hidden", T.suffix) == ""
    assert one(spark, "a.b/c", T.suffix) == ""
    assert one(spark, "a/b/c.Tar.GZ", T.stem) == "c.Tar"
    assert one(spark, "a/.hidden", T.stem) == ".hidden"
    assert one(spark, "a\\b", T.forward_slashes) == "a/b"
    assert one(spark, "image_not_found", T.display_name) == "Image Not Found"
    assert one(spark, "a b/c", T.safe_name) == "a_b_c"


def test_shortening(spark):
    long = "".join(chr(97 + i % 26) for i in range(500))
    assert one(spark, long, lambda c: T.keep_tail(c, 400)) == "..." + long[-397:]
    assert one(spark, long[:400], lambda c: T.keep_tail(c, 400)) == long[:400]
    assert one(spark, long, lambda c: T.keep_head(c, 499, "...")) == long[:499] + "..."
    assert one(spark, "", lambda c: T.or_default(c, "d")) == "d"
    assert one(spark, None, lambda c: T.or_default(c, "d")) == "d"


def test_md5_and_pairs(spark):
    assert one(spark, "d41d8cd98f00b204e9800998ecf8427e", T.is_md5) is True
    assert one(spark, "D41d8cd98f00b204e9800998ecf8427e", T.is_md5) is False
    assert one(spark, "q", lambda c: T.pair(c, F.lit("d"))) == "Query: q\nDocument: d"
    assert one(spark, "q", lambda c: T.pair(c, F.lit("d"), "i")) == "Instruction: i\nQuery: q\nDocument: d"
    assert one(spark, "Été à l'école 42", T.tokens) == ["été", "à", "l", "école", "42"]
