"""Word-processor packages made from the driver's documents, so that reading packages is checked on whole tables.

Every line of a document becomes one block; its number decides what kind: heading, list item, formatted paragraph,
revisions, anchors (bookmark, comment, note, link, fields, ruby, symbol, picture) or a table.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_html
from ..session import SMALL_BATCH_BYTES
from ..sources.packages import one_by_one
from .fixtures import table

# The namespaces of the two formats.
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX_NS = (
    W + ' xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    ' xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml"'
    ' xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    ' xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"')
ODT_NS = " ".join(
    f'xmlns:{p}="{u}"' for p, u in {
        "office": "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "text": "urn:oasis:names:tc:opendocument:xmlns:text:1.0",
        "style": "urn:oasis:names:tc:opendocument:xmlns:style:1.0", "fo": "urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0",
        "table": "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "draw": "urn:oasis:names:tc:opendocument:xmlns:drawing:1.0",
        "svg": "urn:oasis:names:tc:opendocument:xmlns:svg-compatible:1.0", "xlink": "http://www.w3.org/1999/xlink",
        "dc": "http://purl.org/dc/elements/1.1/", "loext": "urn:org:documentfoundation:names:experimental:office:xmlns:loext:1.0"}.items())


def fill(template: str, **values: Column) -> Column:
    """``template`` with {name} replaced by columns."""
    out, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(head), values[name].cast("string")]
    return F.concat(*out, F.lit(rest))


RUN = '<w:r>{fmt}<w:t xml:space="preserve">{text}</w:t></w:r>'
DRAWING = (
    '<w:r><w:drawing><wp:anchor distL="28575" distR="38100" distT="0" distB="0" behindDoc="0"><wp:positionH><wp:posOffset>571500</wp:posOffset></wp:positionH>'
    '<wp:positionV><wp:align>top</wp:align></wp:positionV><wp:extent cx="2286000" cy="1143000"/><wp:wrapSquare/><wp:docPr id="1" descr="pic"/>'
    '<a:graphic><a:blip r:embed="rId3"/></a:graphic></wp:anchor></w:drawing></w:r>')
STYLES = (
    '<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/><w:rPr><w:sz w:val="22"/></w:rPr></w:style>'
    '<w:style w:type="paragraph" w:styleId="Base"><w:name w:val="Base Text"/><w:basedOn w:val="Normal"/><w:pPr><w:pBdr><w:left w:val="double" w:sz="12" w:color="C0FFEE"/><w:top w:val="none"/></w:pBdr><w:jc w:val="both"/><w:spacing w:before="240"/></w:pPr><w:rPr><w:b/></w:rPr></w:style>'
    '<w:style w:type="paragraph" w:styleId="Quote"><w:name w:val="Quote"/><w:basedOn w:val="Base"/><w:pPr><w:ind w:left="720"/><w:tabs><w:tab w:val="right" w:pos="2880"/></w:tabs></w:pPr>'
    '<w:rPr><w:b w:val="0"/><w:i/><w:color w:val="336699"/></w:rPr></w:style>'
    '<w:style w:type="character" w:styleId="Strong"><w:name w:val="Strong"/><w:rPr><w:b/><w:u w:val="single"/><w:strike/></w:rPr></w:style>'
    '<w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/><w:basedOn w:val="Normal"/></w:style>'
    '<w:style w:type="paragraph" w:styleId="Hidden"><w:name w:val="Hidden"/><w:semiHidden/></w:style>')
NUMBERING = (
    '<w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="5"/><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="9"/><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>'
    '<w:abstractNum w:abstractNumId="8"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>'
    '<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num>'
    '<w:num w:numId="3"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="12"/></w:lvlOverride></w:num>')


def docx_parts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, parts): the parts of one docx package per document."""
    d = F.col("doc_id")

    def block(t: Column, i: Column) -> Column:
        text, first, rest = escape_html(t), escape_html(F.substring(t, 1, 5)), escape_html(F.substr(t, F.lit(6)))
        n = F.floor(i / 6)
        v = {"text": text, "first": first, "rest": rest, "i": i, "d": d % 3, "day": 1 + d % 9}
        heading = fill('<w:p><w:pPr><w:pStyle w:val="Heading{h}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>', h=1 + n % 3, **v)
        item = fill('<w:p><w:pPr><w:numPr><w:ilvl w:val="{lvl}"/><w:numId w:val="{num}"/></w:numPr></w:pPr><w:r><w:t>{text}</w:t><w:tab/><w:br/></w:r></w:p>', lvl=n % 3, num=1 + n % 3, **v)
        styled = fill(
            '<w:p><w:pPr><w:pStyle w:val="Quote"/><w:keepNext/>{brk}<w:pBdr><w:top w:val="dashed" w:sz="8" w:color="auto"/><w:bottom w:val="nil"/><w:right w:color="12ab34"/></w:pBdr><w:spacing w:before="240" w:after="120" w:line="360" w:lineRule="auto"/><w:ind w:left="720"/><w:jc w:val="both"/>'
            '<w:shd w:val="clear" w:fill="FFEE00"/><w:tabs>{tabs}<w:tab w:val="clear" w:pos="720"/></w:tabs></w:pPr>'
            '<w:r><w:rPr><w:rStyle w:val="Strong"/><w:b/><w:i w:val="0"/><w:color w:val="ff0000"/><w:sz w:val="28"/><w:rFonts w:ascii="Arial"/><w:smallCaps/></w:rPr><w:t>{first}</w:t></w:r>'
            '<w:r><w:rPr><w:i/><w:u w:val="single"/><w:highlight w:val="yellow"/><w:vertAlign w:val="superscript"/></w:rPr><w:t>{rest}</w:t></w:r></w:p>',
            brk=F.when(n % 3 == 1, "<w:pageBreakBefore/>").otherwise(""), tabs=F.when(n % 2 == 0, '<w:tab w:val="left" w:pos="1440" w:leader="dot"/>').otherwise(""), **v)
        who = 'w:author="a{d}" w:date="2024-01-0{day}T00:00:00Z"'
        revised = fill(
            f'<w:p><w:pPr><w:rPr><w:ins {who}/></w:rPr>{{sect}}</w:pPr><w:ins {who}><w:r><w:t>{{first}}</w:t></w:r></w:ins>'
            '<w:del w:author="b"><w:r><w:delText>{rest}</w:delText></w:r></w:del>'
            '<w:r><w:rPr><w:b/><w:rPrChange w:author="c"><w:rPr><w:i/></w:rPr></w:rPrChange></w:rPr><w:t>x</w:t></w:r></w:p>',
            sect=F.when(n % 2 == 0, fill('<w:sectPr>{type}<w:pgSz w:w="12240" w:h="15840"/><w:bidi/></w:sectPr>', type=F.when(n % 4 == 2, '<w:type w:val="continuous"/>').otherwise(""))).otherwise(""), **v)
        anchors = fill(
            '<w:p><w:bookmarkStart w:id="{i}" w:name="bm{b}"/><w:commentRangeStart w:id="{i}"/><w:r><w:t>{first}</w:t></w:r><w:commentRangeEnd w:id="{i}"/>'
            '<w:r><w:commentReference w:id="{i}"/></w:r><w:bookmarkEnd w:id="{i}"/><w:r><w:footnoteReference w:id="{i}"/></w:r>'
            '<w:hyperlink r:id="rId1"><w:r><w:t>{rest}</w:t></w:r></w:hyperlink><w:hyperlink w:anchor="bm4"><w:r><w:t>go</w:t></w:r></w:hyperlink>'
            '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> REF bm{b}</w:instrText></w:r><w:r><w:instrText> \\h </w:instrText></w:r>'
            '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
            '<w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>see {first}</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
            '<w:fldSimple w:instr=" SEQ Figure \\* ARABIC "><w:r><w:t>{i}</w:t></w:r></w:fldSimple>'
            '<w:ruby><w:rt><w:r><w:t>r{i}</w:t></w:r></w:rt><w:rubyBase><w:r><w:t>{first}</w:t></w:r></w:rubyBase></w:ruby>'
            '<w:r><w:sym w:font="Symbol" w:char="F061"/></w:r><w:sdt/>' + DRAWING + '</w:p>', b=i % 12, **v)
        cells = fill(
            '<w:tbl><w:tblPr><w:tblBorders><w:top w:val="single" w:sz="8" w:color="auto"/><w:insideH w:val="dashed" w:sz="12" w:color="00FF00"/></w:tblBorders></w:tblPr>'
            '<w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>{first}</w:t></w:r></w:p></w:tc>'
            '<w:tc><w:tcPr><w:gridSpan w:val="2"/><w:tcBorders><w:left w:val="nil"/></w:tcBorders></w:tcPr><w:p><w:r><w:t>{rest}</w:t></w:r></w:p></w:tc></w:tr>'
            '<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>z{i}</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>', **v)
        k = i % 6
        return F.when(k == 0, heading).when(k == 1, item).when(k == 2, styled).when(k == 3, revised).when(k == 4, anchors).otherwise(cells)

    lines = F.split("text", "\n")
    anchor_lines = F.filter(F.transform(lines, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: x["i"] % 6 == 4)
    each = lambda f: F.array_join(F.transform(anchor_lines, lambda x: f(x["i"], escape_html(F.substring(x["t"], 1, 5)))), "")
    xml = lambda root, body: F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><{root} {DOCX_NS}>'), body, F.lit(f"</{root}>"))
    final = ('<w:sectPr><w:headerReference w:type="default" r:id="rId2"/><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440" w:right="720" w:bottom="-5" w:left="300"/>'
             '<w:pgBorders><w:top w:val="double" w:sz="12" w:color="ABCDEF" w:space="4"/></w:pgBorders><w:cols w:num="2" w:space="708"/>'
             '<w:pgNumType w:start="3" w:fmt="lowerRoman"/><w:lnNumType w:countBy="5"/><w:vAlign w:val="center"/></w:sectPr>')
    body = F.concat(F.lit("<w:body>"), F.array_join(F.transform(lines, block), ""), F.lit(final + "</w:body>"))
    comment = lambda i, t: fill(
        '<w:comment w:id="{i}" w:author="u{a}" w:date="2024-02-01T00:00:00Z"><w:p w14:paraId="A{i}"><w:r><w:t>{t}</w:t></w:r></w:p>'
        '<w:p w14:paraId="B{i}"><w:r><w:t>u{a} reacted with 👍 x</w:t></w:r></w:p></w:comment>', i=i, a=i % 5, t=t)
    extended = lambda i, _: fill(
        '<w15:commentEx w15:paraId="B{i}" {parent}w15:done="{done}"/>', i=i, parent=F.when(i > 4, 'w15:paraIdParent="B4" ').otherwise(""), done=F.when(i == 4, "1").otherwise("0"))
    note = lambda i, t: fill('<w:footnote w:id="{i}"><w:p><w:r><w:t>note {t}</w:t></w:r></w:p></w:footnote>', i=i, t=t)
    rel = '<Relationship Id="{}" Type="x" Target="{}"/>'
    part = lambda name, text: F.struct(F.lit(name).alias("name"), F.encode(text, "UTF-8").alias("data"))
    return table(spark, sf, "documents").select(d, F.array(
        part("[Content_Types].xml", F.lit("<Types/>")), part("word/document.xml", xml("w:document", body)),
        part("word/_rels/document.xml.rels", F.lit("<Relationships>" + rel.format("rId1", "https://example.org/a?b=1&amp;c=2") + rel.format("rId2", "header1.xml") + rel.format("rId3", "./media/image1.png") + "</Relationships>")),
        part("word/comments.xml", xml("w:comments", each(comment))), part("word/commentsExtended.xml", xml("w15:commentsEx", each(extended))),
        part("word/footnotes.xml", xml("w:footnotes", F.concat(F.lit('<w:footnote w:id="0" w:type="separator"><w:p/></w:footnote>'), each(note)))),
        part("word/settings.xml", xml("w:settings", F.when(d % 3 == 0, "<w:evenAndOddHeaders/>").when(d % 3 == 1, '<w:evenAndOddHeaders w:val="0"/>').otherwise(""))),
        part("word/styles.xml", xml("w:styles", F.lit(STYLES))), part("word/numbering.xml", xml("w:numbering", F.lit(NUMBERING))),
        part("word/header1.xml", xml("w:hdr", fill("<w:p><w:r><w:t>header {n}</w:t></w:r></w:p>", n=d))),
        part("word/media/image1.png", F.concat(F.lit("png"), d % 5))).alias("parts"))


def odt_parts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, parts): the parts of one odt package per document."""
    d = F.col("doc_id")

    def block(t: Column, i: Column) -> Column:
        text, first, rest = escape_html(t), escape_html(F.substring(t, 1, 5)), escape_html(F.substr(t, F.lit(6)))
        n = F.floor(i / 6)
        v = {"text": text, "first": first, "rest": rest, "i": i, "n": n}
        heading = fill('<text:h text:outline-level="{h}" text:style-name="P{p}">{text}</text:h>', h=1 + n % 5, p=n % 3, **v)
        items = fill(
            '<text:list text:style-name="L1"{cont}><text:list-item><text:p>{first}</text:p><text:list><text:list-item><text:p>{rest}</text:p></text:list-item></text:list></text:list-item>'
            '<text:list-item><text:p>z{i}</text:p></text:list-item></text:list>', cont=F.when(n % 2 == 1, ' text:continue-numbering="true"').otherwise(""), **v)
        styled = fill('<text:p text:style-name="P{p}"><text:span text:style-name="T1">{first}</text:span>a<text:s text:c="3"/><text:tab/><text:line-break/><text:span text:style-name="T2">{rest}<text:span text:style-name="T1">!</text:span></text:span></text:p>', p=n % 3, **v)
        revised = fill('<text:p><text:change-start text:change-id="edit-7"/>{first}<text:change-end text:change-id="edit-7"/><text:change text:change-id="edit-8"/>{rest}</text:p>', **v)
        anchors = fill(
            '<text:p><text:bookmark-start text:name="bm{b}"/>{first}<office:annotation office:name="n{i}" loext:resolved="{res}"><dc:creator>u</dc:creator><dc:date>2024-01-01</dc:date><text:p>{first}</text:p><text:p>two</text:p></office:annotation>'
            '<text:bookmark-end text:name="bm{b}"/><office:annotation-end office:name="n{i}"/><text:bookmark text:name="pt{i}"/><text:note text:id="f{i}" text:note-class="{cls}"><text:note-citation>1</text:note-citation><text:note-body><text:p>note {first}</text:p></text:note-body></text:note>'
            '<text:a xlink:href="https://e.org/{i}">{rest}</text:a><text:bookmark-ref text:ref-name="bm{b}" text:reference-format="page">5</text:bookmark-ref><text:sequence text:name="Table">{i}</text:sequence><text:page-number>1</text:page-number>'
            '<text:ruby><text:ruby-base>{first}</text:ruby-base><text:ruby-text>r{i}</text:ruby-text></text:ruby>'
            '<draw:frame draw:style-name="G1" text:anchor-type="paragraph" svg:width="2.54cm" svg:height="1in" svg:x="0.5in"><draw:image xlink:href="Pictures/a.png"/><svg:desc>pic</svg:desc></draw:frame></text:p>',
            b=i % 12, res=F.when(n % 2 == 0, "true").otherwise("false"), cls=F.when(n % 2 == 0, "footnote").otherwise("endnote"), **v)
        cells = fill(
            '<table:table table:style-name="TB"><table:table-column/><table:table-header-rows><table:table-row><table:table-cell table:number-columns-spanned="2" table:style-name="CE2"><text:p>{first}</text:p></table:table-cell>'
            '<table:covered-table-cell/><table:table-cell table:number-rows-spanned="2"><text:p>{rest}</text:p></table:table-cell></table:table-row></table:table-header-rows>'
            '<table:table-row><table:table-cell><text:p>z{i}</text:p></table:table-cell><table:table-cell/><table:covered-table-cell/></table:table-row></table:table>', **v)
        k = i % 6
        return F.when(k == 0, heading).when(k == 1, items).when(k == 2, styled).when(k == 3, revised).when(k == 4, anchors).otherwise(cells)

    changes = (
        '<text:tracked-changes><text:changed-region text:id="edit-7"><text:insertion><office:change-info><dc:creator>first hand</dc:creator><dc:date>2023-11-05T08:30:00</dc:date></office:change-info></text:insertion></text:changed-region>'
        '<text:changed-region xml:id="edit-8"><text:deletion><office:change-info><dc:creator>second hand</dc:creator><dc:date>2023-11-06T17:45:00</dc:date></office:change-info><text:p>struck line</text:p><text:p>and its sequel</text:p></text:deletion></text:changed-region></text:tracked-changes>')
    automatic = (
        '<office:automatic-styles><style:style style:name="P0" style:family="paragraph" style:parent-style-name="Body"><style:paragraph-properties fo:text-align="end" fo:margin-left="1in" fo:margin-top="0.5in" fo:line-height="150%" fo:border="0.75pt dashed #ff0000"/></style:style>'
        '<style:style style:name="P1" style:family="paragraph" style:parent-style-name="Body" style:master-page-name="Wide"><style:paragraph-properties fo:text-indent="1cm"><style:tab-stops><style:tab-stop style:position="2in" style:type="char" style:leader-style="dotted"/></style:tab-stops></style:paragraph-properties></style:style>'
        '<style:style style:name="T1" style:family="text"><style:text-properties fo:font-weight="bold" fo:color="#00ff00" fo:font-size="12.25pt" style:text-position="super 58%"/></style:style>'
        '<style:style style:name="T2" style:family="text" style:parent-style-name="Emphasis"><style:text-properties fo:font-style="italic" style:text-underline-style="solid" fo:letter-spacing="1pt"/></style:style>'
        '<style:style style:name="G1" style:family="graphic"><style:graphic-properties style:wrap="dynamic" style:horizontal-pos="from-left" style:vertical-pos="top" fo:margin-top="0.1in"/></style:style>'
        '<style:style style:name="CE1" style:family="table-cell"><style:table-cell-properties fo:border="1pt solid #0000ff" fo:border-left="none"/></style:style>'
        '<style:style style:name="CE2" style:family="table-cell" style:parent-style-name="CE1"><style:table-cell-properties fo:border-top="2px double #123456"/></style:style>'
        '<text:list-style style:name="L1"><text:list-level-style-number text:level="1" text:start-value="4"/><text:list-level-style-bullet text:level="2"/></text:list-style></office:automatic-styles>')
    named = (
        '<office:styles><style:style style:name="Body" style:display-name="Body_20_Text" style:family="paragraph"><style:paragraph-properties fo:break-after="page"><style:tab-stops><style:tab-stop style:position="1in"/></style:tab-stops></style:paragraph-properties><style:text-properties fo:font-weight="bold"/></style:style>'
        '<style:style style:name="Emphasis" style:family="text"><style:text-properties fo:font-style="italic"/></style:style><style:style style:name="P2" style:family="paragraph" style:parent-style-name="Body"/></office:styles>'
        '<office:automatic-styles><style:page-layout style:name="pm1"><style:page-layout-properties fo:page-width="8.5in" fo:page-height="11in" fo:margin-top="2cm"/></style:page-layout>'
        '<style:page-layout style:name="pm2"><style:page-layout-properties fo:page-width="11in" fo:page-height="8.5in" style:writing-mode="tb-rl"><style:columns fo:column-count="2"><style:column-sep style:width="0.5in"/></style:columns></style:page-layout-properties></style:page-layout></office:automatic-styles>'
        '<office:master-styles><style:master-page style:name="Standard" style:page-layout-name="pm1"><style:header><text:p>head {d}</text:p></style:header><style:footer-left><text:p>left</text:p></style:footer-left></style:master-page><style:master-page style:name="Wide" style:page-layout-name="pm2"/></office:master-styles>')
    lines = F.split("text", "\n")
    content = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><office:document-content {ODT_NS}>{automatic}<office:body><office:text>{changes}'),
                       F.array_join(F.transform(lines, block), ""), F.lit("</office:text></office:body></office:document-content>"))
    part = lambda name, text: F.struct(F.lit(name).alias("name"), F.encode(text, "UTF-8").alias("data"))
    return table(spark, sf, "documents").select(d, F.array(
        part("mimetype", F.lit("application/vnd.oasis.opendocument.text")), part("content.xml", content),
        part("styles.xml", fill(f"<office:document-styles {ODT_NS}>{named}</office:document-styles>", d=d)), part("Pictures/a.png", F.concat(F.lit("png"), d % 5))).alias("parts"))


def zipped(parts: DataFrame, ending: str) -> DataFrame:
    """(doc_id, path, content): the parts as one zip file per document, as a file listing would give them."""
    schema = pa.schema([("doc_id", pa.string()), ("path", pa.string()), ("content", pa.binary())])

    def pack(batches):
        rows, size = [], 0
        for batch in batches:
            for r in one_by_one(batch):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
                    for p in r["parts"]:
                        z.writestr(p["name"], bytes(p["data"]))
                rows.append({"doc_id": str(r["doc_id"]), "path": f"{r['doc_id']}.{ending}", "content": buffer.getvalue()})
                size += len(rows[-1]["content"])
                if size >= SMALL_BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return parts.mapInArrow(pack, "doc_id string, path string, content binary")


def docx_files(spark: SparkSession, sf: str) -> DataFrame:
    """One docx per document; every fiftieth is cut short and every fiftieth-first is an old binary file instead."""
    good = zipped(docx_parts(spark, sf), "docx")
    d = F.col("doc_id").cast("long")
    content = F.when(d % 50 == 0, F.expr("substring(content, 1, 40)")).when(
        d % 50 == 1, F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), F.expr("substring(content, 1, 40)"))).otherwise(F.col("content"))
    return good.withColumn("content", content)


def odt_files(spark: SparkSession, sf: str) -> DataFrame:
    return zipped(odt_parts(spark, sf), "odt")
