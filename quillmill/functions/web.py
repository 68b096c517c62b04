"""Expressions over URLs, file names and raw HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats by extension, and the strategy that handles each.
EXTENSIONS = {
    "pdf": "pdf", "docx": "docx", "doc": "doc", "odt": "odt", "rtf": "rtf", "txt": "text", "md": "markdown", "rst": "restructuredtext", "tex": "latex",
    "csv": "csv", "tsv": "tsv", "xlsx": "excel", "xls": "excel_legacy", "ods": "ods", "json": "json", "jsonl": "jsonlines", "xml": "xml", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "ini": "ini", "html": "html", "htm": "html", "xhtml": "xhtml", "css": "css", "py": "python", "js": "javascript", "ts": "typescript", "jsx": "jsx", "tsx": "tsx",
    "java": "java", "cpp": "cpp", "c": "c", "h": "c_header", "hpp": "cpp_header", "cs": "csharp", "php": "php", "rb": "ruby", "go": "golang", "rs": "rust", "sql": "sql",
    "sh": "shell", "bash": "bash", "ps1": "powershell", "conf": "config", "cfg": "config", "properties": "properties", "env": "environment",
}
STRATEGIES = {
    "document_parser": ["pdf", "docx", "doc", "odt"],
    "text_processor": ["text", "markdown", "restructuredtext", "unknown"],
    "structured_data_processor": ["csv", "tsv", "excel", "excel_legacy", "json", "jsonlines", "xml", "yaml"],
    "web_content_processor": ["html", "xhtml"],
    "code_processor": ["css", "python", "javascript", "typescript", "java", "cpp", "c", "sql"],
}
#: Host names that are never fetched, and patterns of suspicious ones.
BLOCKED_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "169.254.169.254"]
SUSPICIOUS_HOST = "^[0-9]+$|\\.local$|\\.internal$|\\.corp$|\\.(test|dev|stage)$|-admin|metadata|%"
PRIVATE_HOST = "^(10\\.|127\\.|0\\.|169\\.254\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|22[4-9]\\.|2[3-5][0-9]\\.)"
CODE_LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "cpp": "cpp", "c": "c", "h": "c_header"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def format_by_extension(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), extension(path)), F.lit("unknown"))


def strategy(format_name: Column) -> Column:
    return F.coalesce(*[F.when(format_name.isin(names), k) for k, names in STRATEGIES.items()], F.lit("text_processor"))


def content_format(text: Column) -> tuple[Column, Column]:
    """Format by what the first 2048 characters show, and confidence min(0.9, 0.3 + 0.3 * hits)."""
    head = F.substring(text, 1, 2048)
    signs = {
        "html": ["(?i)<!doctype html", "(?i)<html", "(?i)<body"],
        "json": ["^\\s*[\\[{]", "\"[^\"]+\"\\s*:"],
        "xml": ["^\\s*<\\?xml"],
        "markdown": ["(?m)^#{1,6}\\s", "(?m)^```", "\\[[^\\]]+\\]\\([^)]+\\)"],
    }
    hits = {k: sum((head.rlike(p).cast("int") for p in ps), F.lit(0)) for k, ps in signs.items()}
    best = F.greatest(*hits.values())
    name = F.when(best == 0, "text").otherwise(F.coalesce(*[F.when(h == best, F.lit(k)) for k, h in hits.items()]))
    return name, F.when(best == 0, 0.3).otherwise(F.least(F.lit(0.9), 0.3 + 0.3 * best))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def normal_url(url: Column) -> Column:
    """Web addresses without query and fragment; other ids trimmed and lower-cased; empty ones have a name of their own."""
    web = F.regexp_extract(url, "^(https?://[^?#]*)", 1)
    return F.when(F.coalesce(url, F.lit("")) == "", "unknown_source").when(web != "", web).when(F.startswith(url, F.lit("file://")), url).otherwise(F.lower(F.trim(url)))


def url_refusal(url: Column) -> Column:
    """Why a URL is not fetched, null if it may be. Names aren't resolved here."""
    scheme, name = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    port = F.try_to_number(F.nullif(F.regexp_extract(url, "^[^:]+://[^/:]*:([0-9]{1,5})", 1), F.lit("")), F.lit("99999"))
    return (
        F.when(~scheme.isin("http", "https"), "protocol")
        .when(name == "", "no host")
        .when(name.isin(BLOCKED_HOSTS), "blocked host")
        .when(name.rlike(SUSPICIOUS_HOST), "suspicious host")
        .when(name.rlike(PRIVATE_HOST), "address")
        .when(~port.isin(80, 443) & (port < 1024), "port")
        .when(url.rlike("@|%[0-9a-fA-F]{2}|\\\\|\\.\\."), "manipulation")
    )


def filename_refusal(name: Column) -> Column:
    return F.when(F.trim(name) == "", "empty").when(name.rlike("[/\\\\]|\\.\\."), "traversal").when(name.rlike("[\\x00-\\x1f<>:\"|?*]"), "characters").when(F.length(name) > 255, "too long")


def html_facts(html: Column) -> dict[str, Column]:
    """Title, description and counts, by patterns."""
    return {
        "title": F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1),
        "description": F.regexp_extract(html, "(?is)<meta[^>]*name=\"description\"[^>]*content=\"([^\"]*)\"", 1),
        "n_links": F.regexp_count(html, F.lit("(?i)<a[\\s>]")),
        "n_images": F.regexp_count(html, F.lit("(?i)<img[\\s>/]")),
        "has_tables": html.rlike("(?i)<table[\\s>]"),
    }


def markdown_facts(text: Column) -> dict[str, Column]:
    headers = F.regexp_extract_all(text, F.lit("(?m)^#+\\s+(.+)$"), 1)
    return {"n_headers": F.size(headers), "headers": F.slice(headers, 1, 10), "n_lines": F.size(F.split(text, "\n"))}


def code_facts(text: Column) -> dict[str, Column]:
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "^\\s+", ""))
    return {"n_lines": F.size(lines), "n_filled": F.size(F.filter(lines, lambda x: x != "")), "n_comments": F.size(F.filter(lines, lambda x: x.rlike("^(#|//|/\\*)")))}
