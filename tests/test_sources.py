"""Sources on small inline texts and archives."""

import io
import struct
import zipfile

from pyspark.sql import functions as F

from leafmill.functions import webhook as H
from leafmill.sources import archives, markup, stores

SVG = '<svg width="100px" height="50"><rect x="1" y="2" width="30" height="0"/><rect x="1" y="2" width="30" height="9" fill="#fff"/><text x="3" y="4" font-size="9">A</text><image xlink:href="data:image/jpeg;base64,AAEC"/></svg>'
XML = '<fontspec id="1" size="10" family="X" color="#111111"/><page width="900" height="1200"><text left="5" top="6" width="70" height="11" font="1"><b>Hi&amp;</b></text><text left="5" top="6" width="70" height="11" font="9"> </text></page>'


def test_svg(spark):
    df = spark.createDataFrame([(1, SVG)], "doc int, svg string")
    assert [(r.x, r.font_size, r.content, r.font_family) for r in markup.svg_glyphs(df, ["doc"]).collect()] == [(3.0, 9.0, "A", "Helvetica")]
    assert [r.fill for r in markup.svg_rects(df, ["doc"]).collect()] == ["#fff"]
    assert [(r.number, r.kind, bytes(r.content)) for r in markup.svg_images(df, ["doc"]).collect()] == [(1, "jpg", b"\x00\x01\x02")]
    w, h = markup.svg_size(F.col("svg"))
    assert df.select(w, h).first() == (100.0, 50.0)


def test_layout_xml(spark):
    df = spark.createDataFrame([(1, XML)], "doc int, xml string")
    (r,) = markup.xml_lines(df, ["doc"]).collect()
    assert (r.text, r.x, r.font_family, r.font_size, r.bold, r.color) == ("Hi&", 5.0, "X", 10.0, True, "#111111")


def test_odf(spark):
    xml = '<style:style style:name="P1" style:family="text"><style:text-properties fo:font-size="14pt" fo:font-weight="bold"/></style:style><text:p text:style-name="P1">a<text:tab/>b</text:p><text:p> </text:p><text:p text:style-name="Q">c</text:p>'
    df = spark.createDataFrame([(1, xml)], "doc int, xml string")
    out = markup.styled(markup.odf_paragraphs(df, ["doc"]), markup.odf_styles(df, ["doc"]), ["doc"]).orderBy("seq").collect()
    assert [(r.text, round(r.font_size, 6), r.bold) for r in out] == [("a\tb", 14.0, True), ("c", 12.0, False)]


def test_epub_and_hwpx(spark):
    def packed(files):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for k, v in files.items():
                z.writestr(k, v)
        return b.getvalue()

    epub = packed({"META-INF/container.xml": '<c><rootfile full-path="O/p.opf"/></c>', "O/p.opf": '<p><item id="a" href="x%20y.xhtml#f" media-type="application/xhtml+xml"/><itemref idref="a"/><itemref idref="b"/></p>', "O/x y.xhtml": "<p>hi</p>"})
    hwpx = packed({"Contents/section10.xml": "<s><p><t>ten</t></p></s>", "Contents/section2.xml": "<s><p><t>two</t></p></s>"})
    df = spark.createDataFrame([("e", epub), ("bad", b"x")], "path string, content binary")
    got = {(r.path, r.place, r.text, r.skipped) for r in archives.unpacked(df, "epub").collect()}
    assert got == {("e", 0, "<p>hi</p>", None), ("e", 1, None, "missing manifest item"), ("bad", 0, None, "unreadable: BadZipFile")}
    assert [t for _, _, t, _ in archives.hwpx_paragraphs(hwpx)] == ["ten", "two"]


def test_stores(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"sessions": {"i1": {"id": "i1", "user": {"id": "u", "email": "A@x.kr"}, "createdAt": 5}}, "premiumByEmail": {"a@x.kr": {"oneTimePasses": 2}}}')
    (tmp_path / "bad.json").write_text("{")
    s = stores.auth_store(spark, str(tmp_path / "s.json"))
    assert s["sessions"].select("id", "user.email", "createdAt").first() == ("i1", "A@x.kr", 5)
    assert s["premium"].select("email", "oneTimePasses").first() == ("a@x.kr", 2)
    assert stores.auth_store(spark, str(tmp_path / "bad.json"))["premium"].count() == 0
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 640, 480)
    (tmp_path / "p2.pdf").write_bytes(b"%PDF-1.7")
    df = spark.createDataFrame([(png,), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1",)], "c binary")
    assert [tuple(r) for r in df.select(stores.sniff(F.col("c")), *stores.png_size(F.col("c"))).collect()] == [("png", 640, 480), ("ole", None, None)]
    assert stores.uploads(spark, str(tmp_path)).select("kind").first()[0] == "pdf"


def test_webhook(spark):
    assert H.find_string({"a": {"email": "in@x"}, "email": "own@x"}, ("email",)) == "own@x"
    assert H.find_string([{"z": {"email": "first@x"}}, {"email": "second@x"}], ("email",)) == "first@x"
    body = '{"data": {"product": {"id": "p1"}, "customer": {"email": "b@x.kr"}, "expiresAt": "2026-01-01T00:00:00+00:00"}}'
    sig = H.signature(b"k", "d", "1", body)
    df = spark.createDataFrame([("d", "1", body, f"v1,x v1,{sig}"), ("d", "2", body, f"v1,{sig}"), ("d", "1", None, None)], "d string, t string, b string, h string")
    out = df.select(H.purchase(F.col("b")).alias("p"), H.signed("k", F.col("d"), F.col("t"), F.coalesce("b", F.lit("")), F.col("h")).alias("ok")).collect()
    assert tuple(out[0].p) == ("b@x.kr", "p1", "2026-01-01T00:00:00+00:00") and [r.ok for r in out] == [True, False, False]
