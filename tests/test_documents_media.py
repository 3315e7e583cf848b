import io
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.functions import mime
from catalith.operators import chunks as K
from catalith.operators import media as M
from catalith.sources import folder as SRC


def test_windows(spark):
    df = spark.createDataFrame([(1, "abcdefghij", 0), (2, "", 0), (3, None, 0), (4, "a" + " " * 20 + "b", 0)], "doc_id bigint, text string, start int")
    rows = K.fixed_windows(df, size=4, overlap=1).collect()
    assert [(r.chunk_index, r.start, r.chunk) for r in rows if r.doc_id == 1] == [(0, 0, "abcd"), (1, 3, "defg"), (2, 6, "ghij"), (3, 9, "j")]
    assert [r.chunk for r in rows if r.doc_id == 4] == ["a", "b", "b"] and {r.doc_id for r in rows} == {1, 4}


def test_recursive_split():
    text = "First part.\n\n" + "word " * 300 + "\n\nLast."
    out = K.recursive_split(text, 200, 20)
    assert all(len(c) <= 200 for c in out) and out[0] == "First part." and out[-1] == "Last."
    assert K.recursive_split("   ") == [] and K.recursive_split("x" * 1000, 100, 10)[0] == "x" * 100
    assert "".join(K.recursive_split("y" * 950, 100, 0)) == "y" * 950


def test_assembly(spark):
    rows = [("a", 0, "Title", "Head", None), ("a", 1, "NarrativeText", "One two three", 1), ("a", 2, "heading", "Sub", 1), ("a", 3, "ListItem", "Four", 2), ("a", 4, "ListItem", " ", 2), ("b", 0, None, "Alone", None)]
    df = spark.createDataFrame(rows, "asset_id string, seq int, category string, text string, page int")
    out = [tuple(r) for r in K.assembled(df, size=50, overlap=0).orderBy("asset_id", "chunk_index").collect()]
    assert out == [("a", 0, "One two three", "Head", 1, "NarrativeText"), ("a", 1, "Four", "Sub", 2, "ListItem"), ("b", 0, "Alone", None, None, None)]


def test_elements(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# Top\nIntro\n\n- item\n\nText")
    (tmp_path / "sub" / "b.txt").write_text("One\n\nTwo")
    (tmp_path / "sub" / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "skip.png").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    (tmp_path / "odd.xyz").write_text("x")
    (tmp_path / ".catalogignore").write_text("# no pictures\n*.png\n")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:t>Head &amp; more</w:t></w:p><w:p ><w:t>Body</w:t></w:p>')
        z.writestr("word/media/image1.png", b"img")
    (tmp_path / "d.docx").write_bytes(buf.getvalue())
    files = SRC.scan(spark, str(tmp_path), content=True)
    assert {(r.relative_path, r.type) for r in files.collect()} == {("a.md", "document"), ("sub/b.txt", "document"), ("sub/c.pdf", "document"), ("d.docx", "document")}
    stats = SRC.statistics(files).first()
    assert (stats.total_files, stats.document, stats.image) == (4, 4, 0)
    out = {os.path.basename(r.path): [] for r in K.elements(files).collect()}
    for r in K.elements(files).orderBy("path", "seq").collect():
        out[os.path.basename(r.path)].append((r.category, r.text) if r.error is None else "error")
    assert out == {"a.md": [("Title", "Top"), ("NarrativeText", "Intro"), ("ListItem", "- item"), ("NarrativeText", "Text")], "b.txt": [("NarrativeText", "One"), ("NarrativeText", "Two")], "c.pdf": ["error"], "d.docx": [("Title", "Head & more"), ("NarrativeText", "Body")]}
    assert K.embedded_media(buf.getvalue()) == [("word/media/image1.png", b"img")] and K.embedded_media(b"no zip") == []
    assert K.parse_elements(b"<h1>T</h1><script>x</script><p>a <b>b</b></p>", ".html") == [("Title", "T"), ("NarrativeText", "a b")]
    with pytest.raises(FileNotFoundError):
        SRC.scan(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        SRC.scan(spark, str(tmp_path / "a.md"))


def test_blob_store(spark, tmp_path):
    store = SRC.BlobStore(spark, str(tmp_path / "blobs"))
    store.put(spark.createDataFrame([("fs://incoming/r/p/a", b"one"), ("fs://media/clusters/c/b", b"two")], "uri string, content binary"))
    got = {r.uri: (bytes(r.content) if r.content else None, r.found) for r in store.get(spark.createDataFrame([("fs://incoming/r/p/a",), ("fs://none",)], "uri string")).collect()}
    assert got == {"fs://incoming/r/p/a": (b"one", True), "fs://none": (None, False)}
    assert {(r.uri, r.size_bytes) for r in store.list("fs://media").collect()} == {("fs://media/clusters/c/b", 3)}
    assert "content" not in store.list()._jdf.queryExecution().executedPlan().toString()
    store.delete(spark.createDataFrame([("fs://incoming/r/p/a",)], "uri string"))
    assert {r.uri for r in store.list().collect()} == {"fs://media/clusters/c/b"}
    with pytest.raises(ValueError):
        store.get(spark.createDataFrame([("http://x",)], "uri string"))


def test_content_types(spark):
    rows = [(bytes.fromhex("ffd8ff00"), "x.bin"), (b"\x89PNG\r\n\x1a\n", "x"), (b"RIFF0000WEBP", "x"), (b"RIFF0000WAVE", "x"), (b"GIF89a", "x"), (b"??", "y.MP4"), (b"", "z"), (None, None)]
    df = spark.createDataFrame(rows, "content binary, path string")
    assert [r.t for r in df.select(mime.sniffed(F.col("content"), F.col("path")).alias("t")).collect()] == ["image/jpeg", "image/png", "image/webp", "audio/wav", "image/gif", "video/mp4", "application/octet-stream", "application/octet-stream"]


def test_signatures(spark):
    ftyp = lambda brand, size=24: size.to_bytes(4, "big") + b"ftyp" + brand
    rows = [
        (ftyp(b"isom"), "video/mp4"), (ftyp(b"mp42", 32), "video/mp4"), (ftyp(b"qt  ", 20), "video/quicktime"), (ftyp(b"M4A ", 28), "audio/mp4"), (b"ftypisom....", "application/octet-stream"),
        (b"RIFF\x10\0\0\0AVI LIST", "video/x-msvideo"), (b"RIFFWEBPxxxxJUNK", "application/octet-stream"), (b"ID3\x04", "audio/mpeg"), (b"\xff\xfb\x90", "audio/mpeg"), (b"\xff\xf3\x40", "audio/mpeg"), (b"\xff\xf0\x40", "application/octet-stream"),
        (b"\xff\xff\xff", "audio/mpeg"), (b"BM\x36", "image/bmp"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff"), (b"fLaC", "audio/flac"), (b"OggS", "audio/ogg"), (b"%PDF-1.7", "application/pdf"), (b"\x1a\x45\xdf\xa3", "video/x-matroska"),
        (b"PK\x03\x04" + b"\0" * 26 + b"word/document.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), (b"PK\x03\x04" + b"\0" * 26 + b"mimetypeapplication/epub+zip", "application/epub+zip"), (b"GIF87a", "image/gif"), (b"GIF88a", "application/octet-stream"), (b"\xff", "application/octet-stream"),
    ]
    df = spark.createDataFrame([(i, c, "none") for i, (c, _) in enumerate(rows)], "i int, content binary, path string")
    got = [r.t for r in df.orderBy("i").select(mime.sniffed(F.col("content"), F.col("path")).alias("t")).collect()]
    assert got == [t for _, t in rows]


def test_headings_are_carried_over_blocks(spark):
    rows = [(g, i, "Title" if i % 37 == 5 and g != "none" else "Text", f"{g}{i}" * 30) for g in ("a", "none", None) for i in range(200)]
    df = spark.createDataFrame(rows, "grp string, seq bigint, category string, text string")
    want, last = {}, {}
    for g, i, c, t in rows:
        last[g] = t if c == "Title" else last.get(g)
        want[g, i] = last[g]
    for block in (7, 50, 1000):
        out = K.with_headings(df, "grp", "seq", "category", "text", block)
        assert {(r.grp, r.seq): r.heading for r in out.collect()} == want and out.columns == [*df.columns, "heading"]


def test_pictures():
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 255, (64, 48)).astype(float)
    h = M.perceptual_hash(grey)
    assert 0 <= h < 2**64 and h == M.perceptual_hash(grey * 0.5 + 3)
    assert bin(h ^ M.perceptual_hash(grey + rng.normal(0, 1, grey.shape))).count("1") <= 6
    frames = [np.full((8, 8, 3), c, np.uint8) for c in ([250, 0, 0], [240, 5, 5], [0, 250, 0], [0, 0, 250])]
    assert M.diverse_frames(frames, 2)[0] == 0 and 1 not in M.diverse_frames(frames, 3) and M.diverse_frames(frames[:1], 2) == [0]
    assert M.palette(np.concatenate([np.full((3, 3, 3), v, np.uint8) for v in (0, 128, 255)])) == ["#000000", "#808080", "#ffffff"]
    blank = np.zeros((50, 50))
    assert M.text_likely(blank, [("w", 90)] * 9) == (False, 0.0)
    assert M.text_likely(rng.integers(0, 2, (50, 50)) * 255, [("w", 90)] * 5)[0] and not M.text_likely(rng.integers(0, 2, (50, 50)) * 255, [("w", 60)] * 9)[0]


def test_recognised_text_and_pooling(spark):
    df = spark.createDataFrame([(["a", "b", " ", "c", "d"], [95.0, -1.0, 99.0, 59.0, 60.0]), ([], [])], "w array<string>, c array<double>")
    out = [r.r for r in df.select(M.recognised_text(F.col("w"), F.col("c")).alias("r")).collect()]
    assert (out[0].text, out[0].word_count, out[0].mean_confidence) == ("a d", 2, 53.5) and (out[1].text, out[1].mean_confidence) == ("", 0.0)
    rng = np.random.default_rng(1)
    frames = rng.normal(size=(6, 5))
    frames /= np.linalg.norm(frames, axis=1, keepdims=True)
    got = M.attention_pool(spark.createDataFrame([("v", i, [float(x) for x in f]) for i, f in enumerate(frames)], "g string, i int, embedding array<double>"), "g", "i").first().pooled
    want = M.attention_weights(frames) @ frames
    assert np.allclose(got, want / np.linalg.norm(want), atol=1e-9)
    assert spark.range(1).select(M.keyframe_times(F.lit(8.0), 3).alias("t")).first().t == [2.0, 4.0, 6.0]


def test_embedding(spark):
    rows = M.embed(spark.createDataFrame([("a b",), ("a b",), ("c",)], "t string"), "t", M.HashingEmbedder(16)).collect()
    assert rows[0].embedding == rows[1].embedding != rows[2].embedding and abs(np.linalg.norm(rows[0].embedding) - 1) < 1e-6
    with pytest.raises(Exception, match="empty"):
        M.embed(spark.createDataFrame([("",)], "t string"), "t").collect()


def test_metadata_defaults(spark):
    schema = "asset_id string, primary_category string, tags array<string>, description string, scene_type string, suggested_cluster_name string, color_palette array<string>"
    rows = {r.asset_id: r for r in M.with_defaults(spark.createDataFrame([("a", None, None, None, None, None, None), ("b", "food", [f"t{i}" for i in range(20)], "d", "s", "n", ["#111111", "red", "#22222"])], schema)).collect()}
    assert rows["a"].tags == ["unknown", "content"] and rows["a"].color_palette == list(M.GREYS)
    assert len(rows["b"].tags) == 15 and rows["b"].color_palette == ["#111111", *M.GREYS]
