"""Exports of selected rows: XLSX, DOCX, PDF, TSV and an HTML page.

A selection is bounded (200,000 rows), is fetched in its own order and streams
through the driver, partition by partition, into one file.
"""

from __future__ import annotations

import html
import zipfile
import zlib
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ILLEGAL = {c: None for c in range(32) if c not in (9, 10, 13)} | {0xFFFE: None, 0xFFFF: None}


def _x(s) -> str:
    return escape(str(s).translate(_ILLEGAL))


def rows_of(selected: DataFrame, columns: list[str], row_no: str = "row_no") -> Iterable[tuple]:
    """(row number, cells) in selection order; short rows and nulls are empty cells."""
    ordered = selected.orderBy("sel_pos").select(row_no, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    for r in ordered.toLocalIterator():
        yield r[0], list(r[1:])


def write_tsv(out, columns: list[str], rows) -> None:
    out.write("\t".join(columns) + "\n")
    for _, cells in rows:
        out.write("\t".join(cells) + "\n")


def write_parts(selected: DataFrame, columns: list[str], folder: str, step: int = 2000) -> None:
    """TSV files of step rows in selection order, written by tasks; a job that is cut off leaves whole files."""
    line = selected.select((F.col("sel_pos") / step).cast("long").alias("part"), "sel_pos", tsv_line(columns).alias("line"))
    line.repartition("part").sortWithinPartitions("part", "sel_pos").select("part", "line").write.partitionBy("part").text(folder)


def tsv_line(columns: list[str]) -> F.Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{}</Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_REL = '<Relationship Id="rId{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'
_OFFICE = "application/vnd.openxmlformats-officedocument."


def _column(i: int) -> str:
    s = ""
    while i >= 0:
        s, i = chr(65 + i % 26) + s, i // 26 - 1
    return s


def write_xlsx(path, title: str, columns: list[str], rows) -> None:
    """A sheet with a bold header; every cell is text."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        part = lambda n, t: f'<Override PartName="/xl/{n}.xml" ContentType="{_OFFICE}spreadsheetml.{t}+xml"/>'
        z.writestr("[Content_Types].xml", _TYPES.format(part("workbook", "sheet.main") + part("worksheets/sheet1", "worksheet") + part("styles", "styles")))
        z.writestr("_rels/.rels", _RELS.format(_REL.format(1, "officeDocument", "xl/workbook.xml")))
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format(_REL.format(1, "worksheet", "worksheets/sheet1.xml") + _REL.format(2, "styles", "styles.xml")))
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><styleSheet {ns}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{_x(title[:31]) or "Sheet1"}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet {ns}><sheetData>'.encode())
            for n, (no, cells) in enumerate([("#", columns)], 1):
                f.write(_sheet_row(n, [no, *cells], ' s="1"'))
            for n, (no, cells) in enumerate(rows, 2):
                f.write(_sheet_row(n, [no, *cells], ""))
            f.write(b"</sheetData></worksheet>")


def _sheet_row(n: int, cells, style: str) -> bytes:
    out = "".join(f'<c r="{_column(i)}{n}" t="inlineStr"{style}><is><t xml:space="preserve">{_x(c)}</t></is></c>' for i, c in enumerate(cells))
    return f'<row r="{n}">{out}</row>'.encode()


def write_docx(path, title: str, columns: list[str], rows) -> None:
    """A title and a table."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda s, bold=False: f'<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{_x(s)}</w:t></w:r>'
    line = lambda cells, bold=False: "<w:tr>" + "".join(f"<w:tc><w:p>{run(c, bold)}</w:p></w:tc>" for c in cells) + "</w:tr>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES.format(f'<Override PartName="/word/document.xml" ContentType="{_OFFICE}wordprocessingml.document.main+xml"/>'))
        z.writestr("_rels/.rels", _RELS.format(_REL.format(1, "officeDocument", "word/document.xml")))
        with z.open("word/document.xml", "w", force_zip64=True) as f:
            f.write(f'<?xml version="1.0" encoding="UTF-8"?><w:document {w}><w:body><w:p>{run(title, True)}</w:p><w:tbl><w:tblPr/><w:tblGrid/>{line(["#", *columns], True)}'.encode())
            for no, cells in rows:
                f.write(line([no, *cells]).encode())
            f.write(b"</w:tbl><w:p/><w:sectPr/></w:body></w:document>")


_FOLD = str.maketrans("ğĞşŞıİ", "gGsSiI")
PAGE_W, PAGE_H, MARGIN, LEADING, SIZE = 842, 595, 36, 12, 8


def pdf_cell(text: str, width: float) -> bytes:
    """A cell in the page's encoding, cut with an ellipsis to its width."""
    s = " ".join(str(text).translate(_FOLD).split())
    fit = max(1, int(width / (SIZE * 0.5)))
    s = s if len(s) <= fit else s[: fit - 1] + "…"
    return s.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def write_pdf(out, title: str, columns: list[str], rows) -> None:
    """A4 landscape, the header on each page."""
    header = ["#", *columns]
    width = (PAGE_W - 2 * MARGIN) / len(header)
    lines = (PAGE_H - 2 * MARGIN) // LEADING - 2
    offsets: dict[int, int] = {}
    pos = out.write(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n")
    pages: list[int] = []
    number = 4

    def put(n: int, body: bytes) -> None:
        nonlocal pos
        offsets[n] = pos
        pos += out.write(b"%d 0 obj\n%b\nendobj\n" % (n, body))

    def page(held) -> None:
        nonlocal number
        text = [b"BT /F1 10 Tf %d %d Td (%b) Tj ET" % (MARGIN, PAGE_H - MARGIN, pdf_cell(title, PAGE_W - 2 * MARGIN))]
        for i, cells in enumerate([header, *held]):
            for j, c in enumerate(cells):
                text.append(b"BT /F1 %d Tf %.1f %d Td (%b) Tj ET" % (SIZE, MARGIN + j * width, PAGE_H - MARGIN - LEADING * (i + 2), pdf_cell(c, width)))
        packed = zlib.compress(b"\n".join(text))
        put(number, b"<< /Length %d /Filter /FlateDecode >>\nstream\n%b\nendstream" % (len(packed), packed))
        put(number + 1, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (PAGE_W, PAGE_H, number))
        pages.append(number + 1)
        number += 2

    held: list = []
    for no, cells in rows:
        held.append([no, *(list(cells) + [""] * len(columns))[: len(columns)]])
        if len(held) == lines:
            page(held)
            held = []
    if held or not pages:
        page(held)
    put(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    put(2, b"<< /Type /Pages /Count %d /Kids [%b] >>" % (len(pages), b" ".join(b"%d 0 R" % p for p in pages)))
    put(3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
    start = pos
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % number)
    for n in range(1, number):
        out.write(b"%010d 00000 n \n" % offsets[n])
    out.write(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (number, start))


def html_page(title: str, columns: list[str], rows) -> str:
    e = html.escape
    head = "".join(f"<th>{e(c)}</th>" for c in ["#", *columns])
    body = "".join(f"<tr><td>{no}</td>" + "".join(f"<td>{e(c)}</td>" for c in cells) + "</tr>" for no, cells in rows)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{e(title)}</title></head><body><h1>{e(title)}</h1><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></body></html>'
