"""Suspicious-marker rules for document content: one row per token."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: tokens, titles and CVE numbers of the marker rules
EVENTS = ("/OpenAction ", "/AA ", "/Names ", "/AcroForm ", "/XFA ")
ACTIONS = ("/JS ", "/JavaScript", "/Launch", "/SubmitForm", "/ImportData")
ELEMENTS = (
    "/EmbeddedFiles ", "/EmbeddedFile", "/JBIG2Decode", "getPageNthWord", "arguments.callee", "/U3D", "/PRC",
    "/RichMedia", "/Flash", ".rawValue", "keep.previous",
)
JS_MARKERS = (
    "mailto", "Collab.collectEmailInfo", "util.printf", "getAnnots", "getIcon", "spell.customDictionaryOpen",
    "media.newPlayer", "doc.printSeps", "app.removeToolButton", ".SettingContent", "0x01a11d09",
)
SING_FONT = "CoolType.SING.uniqueName"
BMP_RLE = "BMP/RLE heap corruption"
BMP_RLE_TOKEN, BMP_RLE_MORE_THAN = "AAL/AAAC/wAAAv8A", 1000
KNOWN = {
    "mailto": ("mailto", "CVE-2007-5020"),
    "Collab.collectEmailInfo": ("Collab.collectEmailInfo", "CVE-2007-5659"),
    "util.printf": ("util.printf", "CVE-2008-2992"),
    "/JBIG2Decode": ("Adobe JBIG2Decode Heap Corruption", "CVE-2009-0658"),
    "getIcon": ("getIcon", "CVE-2009-0927"),
    "getAnnots": ("getAnnots", "CVE-2009-1492"),
    "spell.customDictionaryOpen": ("spell.customDictionaryOpen", "CVE-2009-1493"),
    "media.newPlayer": ("media.newPlayer", "CVE-2009-4324"),
    ".rawValue": ("Adobe Acrobat Bundled LibTIFF Integer Overflow", "CVE-2010-0188"),
    SING_FONT: (SING_FONT, "CVE-2010-2883"),
    "doc.printSeps": ("doc.printSeps", "CVE-2010-4091"),
    "/U3D": ("/U3D", "CVE-2009-3953,CVE-2009-3959,CVE-2011-2462"),
    "/PRC": ("/PRC", "CVE-2011-4369"),
    "keep.previous": ("Adobe Reader XFA oneOfChild Un-initialized memory vulnerability", "CVE-2013-0640"),
    BMP_RLE: (BMP_RLE, "CVE-2013-2729"),
    "app.removeToolButton": ("app.removeToolButton", "CVE-2013-3346"),
    ".SettingContent": (".SettingContent", "CVE-2018-8414"),
    "0x01a11d09": ("Foxit Reader 9.0.1.1049 Arbitrary Code Execution", "CVE-2018-9958"),
}
#: Characters that end a bounded token.
BOUNDARY = "()<>[]{}/% \t\n\r\f\x00"


def rule_rows() -> list[tuple[str, str, bool, str | None, str | None]]:
    """(category, token, bounded, title, cves) of every literal rule."""
    out = []
    for category, tokens, bounded in (("event", EVENTS, False), ("action", ACTIONS, True), ("element", ELEMENTS, True), ("js_vuln", JS_MARKERS, False)):
        for token in tokens:
            title, cves = KNOWN.get(token.strip(), (None, None))
            out.append((category, token, bounded and not token.endswith(" "), title, cves))
    return out


def rules(spark: SparkSession) -> DataFrame:
    """The rules as a table; callers may pass their own of the same shape."""
    return spark.createDataFrame(rule_rows(), "category string, token string, bounded boolean, title string, cves string")
