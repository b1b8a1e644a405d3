import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.config import SearchConfig, check_chunk_limits
from lodestone.functions import models, scoring, text
from lodestone.languages import detect_language, require_language
from lodestone.report import format_index_summary, format_metrics, format_result, format_size, score_style
from lodestone.sources.repository import decode_source, outside_skipped_directories


def evaluate(spark, rows, schema, column):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r["out"] for r in frame.withColumn("out", column).orderBy("i").collect()]


def test_detect_language(spark):
    paths = ["a.py", "b/C.JAVA", "x.tar.js", "x.jsx", "m.mjs", "c.cjs", "d.go", "e.rb", "f.php", "g.txt", "Makefile", ".py", "a.b/c"]
    got = evaluate(spark, [(p,) for p in paths], "p string", detect_language(F.col("p")))
    assert got == ["python", "java", "javascript", "javascript", "javascript", "javascript", "go", "ruby", "php", None, None, None, None]
    with pytest.raises(ValueError):
        require_language("cobol")


def test_skipped_directories(spark):
    paths = ["a/b.py", ".git/x.py", "a/node_modules/x.js", "a/.hidden.py", "vendor.py", "a/.x/y.py", "venv/z.py"]
    got = evaluate(spark, [(p,) for p in paths], "p string", outside_skipped_directories(F.col("p")))
    assert got == [True, False, False, True, True, False, False]


def test_decode(spark):
    got = evaluate(spark, [(bytearray(b"a\r\nb\rc\xff\xe2\x82d"),)], "b binary", decode_source(F.col("b")))
    assert got == [b"a\r\nb\rc\xff\xe2\x82d".decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")]


SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"


def test_strip_and_normalize_follow_unicode(spark):
    samples = [SPACES + "a" + SPACES + "b" + SPACES, SPACES, "", "x", "a \x85 b c\t\r\n d\xa0\x0b\n\n", "​a"]
    stripped = evaluate(spark, [(s,) for s in samples], "s string", text.strip(F.col("s")))
    assert stripped == [s.strip() for s in samples]
    normal = evaluate(spark, [(s,) for s in samples], "s string", text.normalize_code(F.col("s")))
    assert normal == ["\n".join(x.rstrip() for x in s.strip().splitlines()) for s in samples]


def test_signature(spark):
    rows = [("python", "def f(a: int):\n x"), ("python", "x = 1\ny"), ("java", " int f(){a}"), ("ruby", "def f\n 1"), ("go", "  f  ")]
    got = evaluate(spark, rows, "l string, c string", text.signature(F.col("c"), F.col("l")))
    assert got == ["def f(a:", "x = 1", "int f()", "def f", "f"]


def test_clean_comment(spark):
    rows = [("/**\n * Compute it.\n *  more\n */",), ("// one\n//  two",), ("## a\n#b",), ("/* */",), ("/*= x */",)]
    got = evaluate(spark, rows, "c string", text.clean_comment(F.col("c")))
    # The line rule runs before the closing rule, so a closing line keeps its slash.
    assert got == ["Compute it.\n more\n/", "one\n two", "a\nb", None, "x"]


def test_identifier_and_structured_text(spark):
    rows = [
        ("python", "function", None, "read", "def read():", "Reads.", "def read():\n  pass"),
        ("javascript", "method", "Box", None, "get()", " ", "get() {}"),
        ("php", "class", None, "Repo", "class Repo", None, "class Repo {}"),
        ("go", "class", "", "", "s", "", "c"),
    ]
    schema = "language string, kind string, owner string, name string, sig string, doc string, code string"
    columns = [F.col(c) for c in ("language", "kind", "owner", "name", "sig", "doc", "code")]
    got = evaluate(spark, rows, schema, text.structured_text(*columns))
    assert got == [
        "Language: Python\nFunction: read\nSignature: def read():\nDocumentation: Reads.\nCode:\ndef read():\n  pass",
        "Language: Javascript\nClass: Box\nMethod: <unknown>\nSignature: get()\nDocumentation: \nCode:\nget() {}",
        "Language: Php\nClass: Repo\nSignature: class Repo\nCode:\nclass Repo {}",
        "Language: Go\nClass: <unknown>\nSignature: s\nCode:\nc",
    ]
    plain = evaluate(spark, rows, schema, text.structured_text(*columns, include_docstring=False))
    assert not any("Documentation:" in p for p in plain)
    names = evaluate(spark, [("A", "b"), ("A", None), ("", "b"), (None, "")], "c string, f string", text.identifier(F.col("c"), F.col("f")))
    assert names == ["A.b", "A", "b", "<anonymous>"]


def test_blank_docstring_and_php_tag(spark):
    rows = [('def f():\n  """a\nb"""\n  x', '"""a\nb"""'), ("abc", None), ("abc", ""), ("abc", "zz"), ("x.x", "x")]
    got = evaluate(spark, rows, "c string, d string", text.blank_docstring(F.col("c"), F.col("d")))
    assert got == ["def f():\n  ''\n\n  x", "abc", "abc", "abc", "''.x"]
    tags = evaluate(spark, [("php", "a"), ("php", "\n <?php a"), ("go", "a")], "l string, c string", text.with_php_tag(F.col("c"), F.col("l")))
    assert tags == ["<?php\na", "\n <?php a", "a"]


def test_documentation_leakage(spark):
    doc = "Blend two paints into one."
    rows = [
        ("BLEND   two\npaints into one.", doc), ("/**\n * Blend two\n * paints into one.\n */", doc),
        ("// Blend two\n// paints into one.", doc), ("blend two paints into oneX", doc), ("x", "..."), ("", doc),
    ]
    got = evaluate(spark, rows, "c string, d string", text.contains_documentation(F.col("c"), F.col("d")))
    assert got == [True, True, True, False, False, False]


def test_dedup_key_ignores_trailing_space_only(spark):
    rows = [("f", "a \r\n b\n"), ("f", "\na\n b"), ("g", "a\n b"), ("f", "a\nb"), (None, None)]
    got = evaluate(spark, rows, "f string, c string", text.dedup_key(F.lit("go"), F.col("f"), F.col("c")))
    assert got[0] == got[1] and len(set(got)) == 4


def test_rerank_prompt(spark):
    hinted = evaluate(spark, [("q", "d", "javascript"), ("q", "d", "")], "q string, d string, l string",
                      text.rerank_prompt(F.col("q"), F.col("d"), "judge", F.col("l")))
    assert hinted == [
        "<Instruct>: judge\n<Query>: q\nThe document is source code written in Javascript.\n<Document>: d",
        "<Instruct>: judge\n<Query>: q\n<Document>: d",
    ]


@pytest.mark.parametrize(
    "row,expected",
    [
        (("open door", "open_door", None, None), 0.7),
        (("open door", "open_door_file", None, None), 0.4),
        (("open door", "close_gate", None, None), 0.0),
        (("open door", None, None, "Opens: open"), 0.15),
        (("open door", "open_door", None, "open door"), 1.0),
        (("", "x", None, None), 0.4),
        (("open", "", "Opener", None), 0.4),
    ],
)
def test_metadata_bonus(spark, row, expected):
    columns = [F.col(c) for c in "qfcd"]
    (got,) = evaluate(spark, [row], "q string, f string, c string, d string", scoring.metadata_bonus(*columns))
    assert got == pytest.approx(expected)


def test_scores(spark):
    got = evaluate(spark, [(0.5, 0.8, 1.0)], "s double, r double, b double", F.array(
        scoring.final_score(F.col("s"), F.col("r"), F.col("b")),
        scoring.final_score(F.col("s"), F.col("r"), F.col("b"), {"reranker": 1.0}),
        scoring.final_score(F.col("s"), F.col("r"), F.col("b"), reranking=False),
        scoring.yes_probability(F.col("s"), F.col("s")),
    ))
    assert got[0] == pytest.approx([0.75, 0.95, 0.5, 0.5])


def test_embedder_and_pooling():
    vectors = models.HashingEmbedder(32).embed_documents(pa.array(["Open Door", "door open", "", "..."]))
    assert np.allclose(vectors[0], vectors[1]) and np.isclose(np.linalg.norm(vectors[0]), 1)
    assert not vectors[2:].any()
    hidden = np.arange(12).reshape(2, 3, 2)
    right = np.array([[1, 1, 0], [1, 1, 1]])
    assert models.last_token_pool(hidden, right).tolist() == [[2, 3], [10, 11]]
    left = np.array([[0, 1, 1], [1, 1, 1]])
    assert models.last_token_pool(hidden, left).tolist() == [[4, 5], [10, 11]]


def test_embedder_choice():
    made = {n: models.embedder_factory(SearchConfig(embedding_model=n)).func.__name__ for n in ("hashing", "Qwen/Qwen3-Embedding-8B", "other/mini")}
    assert list(made.values()) == ["HashingEmbedder", "InstructionEmbedder", "SentenceEmbedder"]


def test_plugged_reranker(spark):
    class Longest:
        def score(self, prompts):
            return [len(p) / 1000 for p in prompts]

    config = SearchConfig(reranker_language_hint=True)
    column = models.reranker_column(config, F.col("q"), F.col("d"), F.lit("go"), Longest)
    (got,) = evaluate(spark, [("q", "d")], "q string, d string", column)
    assert got == (len(config.reranker_instruction) + len("<Instruct>: \n<Query>: q\nThe document is source code written in Go.\n<Document>: d")) / 1000
    off = SearchConfig(enable_reranking=False)
    assert evaluate(spark, [("q", "d")], "q string, d string", models.reranker_column(off, F.col("q"), F.col("d"), F.lit("go"))) == [None]


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("max_chunk_chars: 80\nchunk_overlap_chars: 8\nunknown: 1\n")
    config = SearchConfig.from_yaml(str(path))
    assert (config.max_chunk_chars, config.chunk_overlap_chars, config.retrieval_top_k) == (80, 8, 50)
    path.write_text("")
    assert SearchConfig.from_yaml(str(path)) == SearchConfig()
    for bad in ((0, 0), (-1, 0), (10, -1), (10, 10), (10, 11), (True, 0), (10, False), (1.5, 0)):
        with pytest.raises(ValueError):
            check_chunk_limits(*bad)
        with pytest.raises(ValueError):
            SearchConfig(max_chunk_chars=bad[0], chunk_overlap_chars=bad[1])
    assert SearchConfig(max_chunk_chars=None, chunk_overlap_chars=999).max_chunk_chars is None
    for wrong in ({"chunker_type": "x"}, {"query_rewrite_strategy": "x"}, {"query_rewriter_max_new_tokens": 0}):
        with pytest.raises(ValueError):
            SearchConfig(**wrong)


def test_report():
    assert [format_size(n) for n in (1, 2048, 3 * 1024**2, 1024**4)] == ["1.0B", "2.0KB", "3.0MB", "1.0TB"]
    assert [score_style(s) for s in (0.8, 0.5, 0.1)] == ["green", "yellow", "red"]
    table = format_metrics([{"language": "overall", "mrr": 0.5}, {"language": "go", "recall_at_1": 1.0}])
    assert table.splitlines()[1].split() == ["go", "1.0000", "0.0000", "0.0000", "0.0000", "0.0000"]
    row = {"final_score": 0.9, "file_path": "a.go", "class_name": None, "function_name": None, "language": "go",
           "start_line": 1, "end_line": 2, "source_code": "x\ny", "reranker_score": None}
    assert "<anonymous>" in format_result(1, row) and "Lines:     1–2" in format_result(1, row)
    assert "Languages:  go" in format_index_summary("p", 1000, 8, ["go"])


def test_an_embedder_remembers_a_bounded_number_of_tokens():
    """What a worker keeps must not grow to tens of MB with the vocabulary of the corpus."""
    import pyarrow as pa

    from lodestone.functions.models import HashingEmbedder

    embedder = HashingEmbedder(64)
    for at in range(0, 50_000, 1_000):
        embedder.embed_documents(pa.array([" ".join(f"t{i}" for i in range(at, at + 1_000))]))
    assert embedder._bucket.cache_info().currsize <= 1 << 15
