"""Documents of each kind, whole; broken ones as rows with an error; new files once in a stream."""

import io
import zipfile
import zlib

from engram.sources import documents as D


def pdf(*pages, packed=True, cmap=None, object_stream=False):
    """A small PDF of the given content streams."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))), len(pages))}
    stream = lambda data, more=b"": b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), more, data)
    objects[3] = b"<< /Type /Font /Subtype /Type0%s >>" % (b" /ToUnicode 4 0 R" if cmap else b"")
    if cmap:
        objects[4] = stream(zlib.compress(cmap), b"/Filter /FlateDecode ")
    for i, text in reversed(list(enumerate(pages))):  # pages come in the order of the tree, not of the file
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = stream(zlib.compress(text), b"/Filter /FlateDecode ") if packed else stream(text)
    if object_stream:
        inside = [n for n in objects if b"stream" not in objects[n]]
        places, body = [], b""
        for n in inside:
            places.append(b"%d %d" % (n, len(body)))
            body += objects.pop(n) + b" "
        head = b" ".join(places) + b" "
        objects[99] = stream(zlib.compress(head + body), b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode " % (len(inside), len(head)))
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGE = rb"BT /F1 12 Tf 72 700 Td (Hello \(nested\) w\157rld) Tj 0 -14 Td [(Kern) 20 (ed) -300 (words)] TJ T* <4869> Tj ET"


def test_pdf_text():
    want = "Hello (nested) world\nKerned words\nHi"
    for packed in (True, False):
        assert D.pdf_text(pdf(PAGE, packed=packed)) == want
    assert D.pdf_text(pdf(PAGE, b"BT (second) Tj ET", object_stream=True)) == want + "\n\nsecond"
    cmap = b"1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <00E9> <0020> <0021> <0041> endbfrange"
    assert D.pdf_text(pdf(b"BT /F1 9 Tf <0020002100030010> Tj ET", cmap=cmap)) == "AB é"
    assert D.pdf_text(pdf(b"q 10 0 0 10 0 0 cm /Im1 Do Q")) == ""


def test_folder(spark, tmp_path):
    long = "a text of more than thirty characters, whole. " * 3
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>%s</w:t></w:r></w:p></w:body></w:document>' % long.strip())
    show = b"BT (" + long.encode() + b") Tj ET"
    files = {
        "a.txt": long.encode(), "sub/b.MD": long.encode() * 5000, "short.txt": b"short", "c.docx": word.getvalue(), "d.pdf": pdf(show), "scan.pdf": pdf(b"q Q"), "e.png": b"\x89PNG", "skip.exe": long.encode(), "~lock.txt": long.encode(),
        "broken.docx": b"no zip", "broken.pdf": b"%PDF-1.4 1 0 obj << /Type /Page /Contents 2 0 R >> endobj 2 0 obj << /Filter /FlateDecode >>\nstream\nxx\nendstream endobj", "no.pdf": b"text", "locked.pdf": pdf(show) + b"/Encrypt",
    }
    for name, data in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in D.documents(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"a.txt", "b.MD", "c.docx", "d.pdf", "scan.pdf", "e.png", "broken.docx", "broken.pdf", "no.pdf", "locked.pdf"}
    assert got["a.txt"].content == long and len(got["b.MD"].content) == 5000 * len(long) and got["c.docx"].content == got["d.pdf"].content == long.strip()
    assert {n for n, r in got.items() if r.error} == {"broken.docx", "broken.pdf", "no.pdf", "locked.pdf"} and {n for n, r in got.items() if r.needs_vision} == {"scan.pdf", "e.png"}
    seen = D.documents(spark, str(tmp_path / "in"), vision=lambda kind, data: f"{kind} of {len(data)} bytes, described").where("needs_vision").collect()
    assert {r.kind for r in seen} == {"pdf", "image"} and all("described" in r.content for r in seen)
    # As a stream: each new file once.
    stream = lambda: D.documents(spark, str(tmp_path / "in"), stream=True).select("path", "content").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    stream()
    (tmp_path / "in" / "new.txt").write_bytes(long.encode())
    stream()
    names = [r.path.rsplit("/", 1)[-1] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(names) == sorted([*got, "new.txt"])
