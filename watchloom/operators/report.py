"""Reports and history: match rows, JSON, workbooks, pages, status."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lists' display names.
LABELS = {
    "ofac_sdn": "OFAC SDN", "ofac_cons": "OFAC Consolidated", "un_consolidated": "UN Security Council", "eu_fsf": "EU Financial Sanctions",
    "uk_sanctions": "UK Sanctions List", "ca_sema": "Canada SEMA", "ch_seco": "Switzerland SECO", "australia_dfat": "Australia DFAT",
    "wikidata_peps": "Wikidata Global PEPs", "us_congress": "US Congress", "uk_parliament": "UK Parliament", "eu_parliament": "EU Parliament",
    "fbi_wanted": "FBI Most Wanted",
}
DECISIONS = "array<struct<match_number:int,decision:string,cleared_by:string>>"


def label(source: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.element_at(m, source), source)


def match_rows(screenings: DataFrame) -> DataFrame:
    """One row a match of every distinct screening; unreadable match lists count as empty."""
    s = screenings.select("id", "matches").distinct()
    return s.select("id", F.explode(F.coalesce(F.from_json("matches", DECISIONS), F.array().cast(DECISIONS))).alias("m")).select("id", "m.*")


def report_row(entity: DataFrame) -> DataFrame:
    """The person part of a report row: up to four aliases and three identifiers as text."""
    from .resolve import id_list, items

    ids = F.transform(F.slice(id_list(F.col("identifiers")), 1, 3), lambda i: F.concat(i["type"], F.lit(": "), i["value"]))
    return entity.select(
        "id", F.coalesce("name", F.lit("")).alias("matched_person"), F.array_join(F.slice(items(F.col("aliases")), 1, 4), ", ").alias("aliases"),
        F.array_join(items(F.col("dob")), ", ").alias("dob"), F.array_join(items(F.col("nationality")), ", ").alias("nationality"),
        F.coalesce("gender", F.lit("")).alias("gender"), label(F.col("source")).alias("source_list"), F.array_join(ids, "; ").alias("identifiers"),
    )


def history_page(screenings: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of distinct screenings, latest first."""
    return screenings.select("id", "created_at", "result", "screened_by").distinct().orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def source_status(meta: DataFrame) -> DataFrame:
    """Latest attempt of every source."""
    last = meta.groupBy("source").agg(F.max(F.struct("last_fetched", "status", "entity_count")).alias("m"))
    return last.select("source", "m.last_fetched", "m.status", F.coalesce("m.entity_count", F.lit(0)).cast("long").alias("entity_count"))


def history_total(screenings: DataFrame) -> DataFrame:
    """How many distinct screenings ``history_page`` pages through."""
    return screenings.select("id", "created_at", "result", "screened_by").distinct().agg(F.count("*").alias("total"))


def healthy_versions(meta: DataFrame) -> DataFrame:
    """One row: ``source=hash`` of every source whose latest attempt succeeded, in order; there are as many as feeds."""
    last = meta.groupBy("source").agg(F.max(F.struct("last_fetched", "status", "entity_count", "file_hash")).alias("m")).filter("m.status = 'ok'")
    return last.agg(F.array_join(F.array_sort(F.collect_list(F.concat("source", F.lit("="), F.coalesce("m.file_hash", F.lit(""))))), ";").alias("versions"))


def screening_label(created_at: Column, key: Column) -> Column:
    """``SCR-YYYYMMDD-`` and six hexadecimal digits of the key's hash."""
    return F.concat(F.lit("SCR-"), F.date_format(created_at, "yyyyMMdd"), F.lit("-"), F.upper(F.substring(F.sha2(key, 256), 1, 6)))


STATS = ("raw_candidates", "unique_persons", "auto_cleared", "auto_flagged", "sent_to_llm", "llm_cleared", "llm_flagged", "llm_escalated", "processing_ms")


def screening_json(screenings: DataFrame) -> DataFrame:
    """id, report: every screening as a JSON object with its counters nested, fields in a fixed order."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    stats = F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in STATS]).alias("stats")
    return screenings.select("id", F.to_json(F.struct(blank("id"), blank("result"), blank("screened_by"), stats, F.coalesce("matches", F.lit("[]")).alias("matches"))).alias("report"))


def numbered_routes(flagged: DataFrame, cleared: DataFrame, reviewed: DataFrame, second: DataFrame | None = None, citations: DataFrame | None = None) -> DataFrame:
    """screening_id, match_number, person, decision, reason, cleared_by, citations: the three routes of a screening as one report.

    Each route has screening_id, person, ord, decision, reason, cleared_by; flagged matches come first, then cleared, then
    reviewed ones, each in their order.  ``second`` (screening_id, person, decision, reason, cleared_by) overrides what it decides, numbers
    kept; of ``citations`` (screening_id, person, ord, url) the first three that aren't blank are joined.
    """
    from pyspark.sql import Window

    parts = [df.withColumn("route", F.lit(i)) for i, df in enumerate((flagged, cleared, reviewed))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = every.withColumn("match_number", F.row_number().over(Window.partitionBy("screening_id").orderBy("route", "ord", "person")))
    key = ["screening_id", "person"]
    if second is not None:
        s = second.select(*key, *[F.col(c).alias("_" + c) for c in ("decision", "reason", "cleared_by")])
        out = out.join(s, key, "left")
        for c in ("decision", "reason", "cleared_by"):
            out = out.withColumn(c, F.coalesce("_" + c, c)).drop("_" + c)
    if citations is not None:
        c = citations.filter(F.trim(F.coalesce("url", F.lit(""))) != "").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", "url"))).alias("u"))
        out = out.join(c.select(*key, F.array_join(F.slice(F.col("u.url"), 1, 3), "; ").alias("citations")), key, "left")
    else:
        out = out.withColumn("citations", F.lit(None).cast("string"))
    return out.select("screening_id", "match_number", "person", "decision", "reason", "cleared_by", F.coalesce("citations", F.lit("")).alias("citations"))


def to_report_json(df: DataFrame) -> DataFrame:
    """id, report: every row as a JSON object, fields in order."""
    return df.select("id", F.to_json(F.struct(*df.columns)).alias("report"))


# Fill colours of decisions.
_FILL = {"CLEARED": "C6EFCE", "LIKELY_MATCH": "FFC7CE", "ESCALATE": "FFEB9C"}


def _column(i: int) -> str:
    s = ""
    while i >= 0:
        s, i = chr(65 + i % 26) + s, i // 26 - 1
    return s


def workbook(sheets: dict[str, list[list[object]]]) -> bytes:
    """An XLSX file of plain sheets: first row bold, frozen and filtered; rows coloured by a decision in column B.

    For one screening at a time, collected by its id; cell texts are cut at the format's 32,000 characters.
    """
    styles = (
        '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="5"><fill/><fill/>'
        + "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in _FILL.values())
        + '</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="5"><xf/><xf fontId="1" applyFont="1"/>'
        + "".join(f'<xf fillId="{i + 2}" applyFill="1"/>' for i in range(3)) + "</cellXfs></styleSheet>"
    )
    style_of = {d: i + 2 for i, d in enumerate(_FILL)}
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names))) + "</Types>")
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="s{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="s{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + '<Relationship Id="st" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", styles)
        for i, n in enumerate(names):
            rows = []
            for r, row in enumerate(sheets[n], 1):
                style = 1 if r == 1 else style_of.get(str(row[1]).upper(), 0) if len(row) > 1 else 0
                cells = "".join(f'<c r="{_column(c)}{r}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str("" if v is None else v)[:32000])}</t></is></c>' for c, v in enumerate(row))
                rows.append(f'<row r="{r}">{cells}</row>')
            last = f"{_column(max((len(r) for r in sheets[n]), default=1) - 1)}{max(len(sheets[n]), 1)}"
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>' + "".join(rows) + f'</sheetData><autoFilter ref="A1:{last}"/></worksheet>')
    return buf.getvalue()
