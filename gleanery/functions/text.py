"""Text, hash, CSV and Markdown functions. SQL expressions, except Unicode normalisation and HTML entities."""

from __future__ import annotations

import hashlib
import html
import json
import os
import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def _lines(text: Column, breaks: str) -> Column:
    """Lines with runs of space, tab and ideographic space collapsed, trimmed of all Unicode white space."""
    return F.transform(F.split(text, breaks), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t　]+", " "), r"(?U)^\s+|\s+$", ""))


def collapsed_lines(text: Column) -> Column:
    """Text for content hashes, given NFKC text: every line break counts, blank lines go."""
    kept = F.filter(_lines(text, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"), lambda x: x != "")
    return F.array_join(kept, "\n")


def content_hash(text: Column, normalised: bool = False) -> Column:
    """``sha256:`` and 64 hex digits of the collapsed text; ``normalised``: the text is NFKC already."""
    return F.concat(F.lit("sha256:"), F.sha2(collapsed_lines(text if normalised else nfkc(text)), 256))


def hash_text(text: Column, normalised: bool = False) -> Column:
    """Text for exported hashes: NFC, line feeds only, collapsed and trimmed lines, at most two blank lines."""
    body = text if normalised else nfc(text)
    one = F.regexp_replace(body, "\r\n|\r", "\n")
    return F.regexp_replace(F.array_join(_lines(one, "\n"), "\n"), "\n{4,}", "\n\n\n")


def spec_hash(title: Column, text: Column, normalised: bool = False) -> Column:
    """Bare hex sha256 of title, line feed and body."""
    return F.sha2(F.concat(hash_text(title, normalised), F.lit("\n"), hash_text(text, normalised)), 256)


def hash_scope(content_type: Column, attachments: Column) -> Column:
    """What a hash covers. ``attachments``: array of structs with a status, or null."""
    read = F.coalesce(F.exists(attachments, lambda a: a["status"] == "ok"), F.lit(False))
    return F.when(content_type == "pdf", "title+pdf_text").when(read, "title+main_text+attachments").otherwise("title+main_text")


def hash_fields(title: Column, text: Column, content_type: Column, status: Column, attachments: Column, normalised: bool = False) -> Column:
    """Struct (hash, status, scope); unavailable unless the body was read. A title alone is never hashed."""
    usable = F.coalesce((status == "ok") & (F.length(text) > 0), F.lit(False))
    return F.struct(
        F.when(usable, spec_hash(title, text, normalised)).alias("hash"),
        F.when(usable, "ok").otherwise("unavailable").alias("status"),
        F.when(usable, hash_scope(content_type, attachments)).alias("scope"),
    )


def searchable(text: Column) -> Column:
    """NFKC and lower case, for search."""
    return F.lower(nfkc(text))


def squeezed(text: Column) -> Column:
    """NFKC without any white space, for evidence."""
    return F.regexp_replace(nfkc(text), r"(?U)\s+", "")


def plain_text(text: Column) -> Column:
    """Without tags and entities, collapsed; the input itself if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(unescaped(F.regexp_replace(text, "<[^>]*>", "")), r"(?U)\s+", " "), "^ | $", "")
    return F.when(plain == "", text).otherwise(plain)


def short(text: Column, limit: int = 120) -> Column:
    flat = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def article_id(url: Column) -> Column:
    """``a_`` and the first 16 hex digits of the canonical URL's sha256."""
    return F.concat(F.lit("a_"), F.substring(F.sha2(url, 256), 1, 16))


#: Marks that Markdown or HTML would interpret, and what a spreadsheet would take for a formula.
MARKS = r"([\\`*_{}\[\]()#+\-.!|<>~])"
FORMULA, CONTROL = r"(?U)^\s*[=+\-@]", "^[\t\r]"


def markdown(text: Column) -> Column:
    """Markdown and HTML marks escaped, line feeds as spaces."""
    return F.regexp_replace(F.regexp_replace(text, "\n", " "), MARKS, r"\\$1")


def markdown_url(url: Column) -> Column:
    for mark, code in (("(", "%28"), (")", "%29"), (" ", "%20"), ("<", "%3C"), (">", "%3E")):
        url = F.replace(url, F.lit(mark), F.lit(code))
    return url


def csv_cell(value: Column) -> Column:
    """One CSV cell: a quote mark before what a spreadsheet would take for a formula, RFC 4180 quoting."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    guarded = F.when(text.rlike(FORMULA) | text.rlike(CONTROL), F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(guarded.rlike('[",\r\n]'), quoted).otherwise(guarded)


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *map(csv_cell, cells))


def embedded_json(text: Column) -> Column:
    """JSON that is safe inside a script element."""
    for mark, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def excerpt(status: Column, summary: Column, points: Column, most: int = 1000) -> Column:
    """Summary and points of a success, cut at ``most`` characters; else empty. Fixed value: the heading's wording."""
    kept = F.filter(F.coalesce(points, F.array().cast("array<string>")), lambda p: p != "")
    full = F.when(F.size(kept) > 0, F.concat(summary, F.lit(" 【主な論点】"), F.array_join(kept, " / "))).otherwise(summary)
    cut = F.when(utf16_length(full) > most, F.concat(F.substring(full, 1, most - 1), F.lit("…"))).otherwise(full)
    return F.when((status == "success") & (F.length(summary) > 0), cut).otherwise("")


def category(tags: Column) -> Column:
    """Names of tags that are not retired, joined by slashes. ``tags``: array of structs (name, retired)."""
    return F.array_join(F.transform(F.filter(tags, lambda t: ~t["retired"]), lambda t: t["name"]), "/")


def csv_source_id(csv_id: Column, source_id: Column) -> Column:
    return F.coalesce(csv_id, F.regexp_replace(F.upper(source_id), "[^A-Z0-9]+", "_"))


def csv_source_type(url: Column, source_type: Column) -> Column:
    """PDF notices by the URL's path, else the source's type, else news."""
    path = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[a-zA-Z]+://[^/]*", "")
    return F.when(F.lower(path).endswith(".pdf"), "notice_pdf").otherwise(F.coalesce(F.when(source_type != "", source_type), F.lit("news")))


def document_type(content_type: Column, url: Column, head: Column) -> Column:
    pdf = F.lower(content_type).contains("pdf") | F.lower(url).endswith(".pdf") | head.startswith("%PDF-")
    return F.when(F.coalesce(pdf, F.lit(False)), "pdf").otherwise("html")


def retry_kind(reason: Column) -> Column:
    """Words by which reasons are told apart."""
    return F.when(reason.contains("サイズ上限"), "size_limit").when(reason.contains("添付"), "attachment").otherwise("other")


def prompt_text(text: Column, most: int = 20_000) -> Column:
    """Text for a prompt: cut at ``most`` characters, its delimiters neutralised by wide angle brackets (fixed value)."""
    cut = F.substring(text, 1, most)
    return F.replace(F.replace(cut, F.lit("<document"), F.lit("＜document")), F.lit("</document"), F.lit("＜/document"))


def safe_href(url: Column) -> Column:
    return F.when(url.rlike("(?i)^(https?://|#)"), url).otherwise("#")


#: Token shapes that must not be published.
SECRET_PATTERNS = [
    "sk-[A-Za-z0-9_-]{16,}",
    "gh[pousr]_[A-Za-z0-9]{20,}",
    "AKIA[0-9A-Z]{16}",
    "AIza[0-9A-Za-z_-]{30,}",
    "xox[baprs]-[A-Za-z0-9-]{10,}",
]


#: Fixed value: names of environment variables that hold secrets.
SECRET_NAMES = re.compile("KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL", re.IGNORECASE)


def secret_values(environ: Mapping[str, str] | None = None) -> list[str]:
    """Values of eight characters or more of the environment's variables with secret names."""
    environ = os.environ if environ is None else environ
    return [v for k, v in environ.items() if SECRET_NAMES.search(k) and len(v) >= 8]


def has_secret(text: Column, values: Sequence[str] = ()) -> Column:
    """Whether a text holds a token of a known shape, or one of the given values of eight characters or more
    (``secret_values`` gives those of an environment)."""
    found = F.lit(False)
    for p in SECRET_PATTERNS:
        found |= text.rlike(p)
    for v in values:
        if len(v) >= 8:
            found |= text.contains(v)
    return F.coalesce(found, F.lit(False))


def forbidden_path(path: Column) -> Column:
    """Why a path must not be kept in a repository, or null. Names, folders and endings."""
    name = F.regexp_extract(path, "[^/]*$", 0)
    folder = F.regexp_extract(path, r"(?:^|/)(\.cache|node_modules|\.venv|logs)/", 1)
    env = (name == ".env") | name.startswith(".env.")
    return F.when(
        name == ".env.example",
        F.lit(None).cast("string"),
    ).when(env, ".env").when(folder != "", F.concat(folder, F.lit("/"))).when(name.rlike(r"^.+\.log$"), ".log")


def unsafe_files(files: DataFrame, most_bytes: int = 2_000_000) -> DataFrame:
    """``path, problem`` of files (``path, content`` as bytes) that must not be committed: by their path, else by a
    token in their text. Files beyond ``most_bytes`` and files with a zero byte are not searched."""
    text = F.when((F.octet_length("content") <= most_bytes) & ~F.contains(F.col("content"), F.lit(b"\x00")), F.decode("content", "UTF-8"))
    problem = F.coalesce(forbidden_path(F.col("path")), F.when(has_secret(text), F.lit("secret")))
    return files.select("path", problem.alias("problem")).where("problem is not null")


#: Wording for statuses, methods, precisions and origins of tags.
LABELS = {
    "run_status": {"success": "成功", "partial": "一部失敗", "failed": "失敗", "running": "実行中"},
    "source_status": {"success": "成功", "failed": "失敗", "skipped": "対象外", "unsupported": "未対応"},
    "method": {"rss": "RSS", "html": "HTML一覧", "sitemap": "サイトマップ", "manual": "手動登録"},
    "summary_status": {
        "success": "要約済み",
        "pending": "未要約（処理待ち）",
        "skipped_no_api_key": "未要約（AI未実行：APIキー未設定）",
        "skipped_no_content": "未要約（本文を取得できないため）",
        "failed_api_error": "未要約（AI APIエラー）",
        "failed_invalid_output": "未要約（AI出力の検証に失敗）",
        "failed_limit_exceeded": "未要約（処理上限を超過）",
        "failed_refusal": "未要約（AIが応答を拒否）",
        "not_processed": "未要約（AI処理なし）",
    },
    "content_status": {"ok": "本文取得済み", "failed": "本文未取得（取得失敗）", "unsupported": "本文未取得（未対応の形式）", "not_fetched": "本文未取得"},
    "article_status": {"active": "掲載中", "missing_from_listing": "一覧に見当たらない", "manual": "手動登録", "unsupported": "自動取得の対象外"},
    "date_method": {
        "rss_pubdate": "RSSの公開日",
        "rss_updated": "RSSの更新日",
        "html_meta": "ページのメタ情報",
        "html_text": "ページ本文の記載",
        "pdf_metadata": "PDFの文書情報",
        "pdf_text": "PDF本文の記載",
        "listing_text": "一覧ページの記載",
        "url_pattern": "URL中の日付",
        "page_data": "ページに埋め込まれたデータ",
        "manual": "手動登録",
    },
    "precision": {"datetime": "日時まで", "day": "日まで", "month": "月まで", "year": "年まで", "unknown": "不明"},
    "origin": {"ai": "AI", "human": "人が追加", "source": "設定", "rule": "一致"},
    "origin_title": {"ai": "AIが付与", "human": "人が追加したタグ", "source": "情報源の設定で付与", "rule": "ルール（キーワード一致）で付与"},
}


def label(kind: str, value: Column) -> Column:
    """The wording for a value, or the value itself."""
    pairs = [F.lit(x) for kv in LABELS[kind].items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def definition_hash(definition: object) -> str:
    """Version of a definition: sha256 of its canonical JSON."""
    return "sha256:" + hashlib.sha256(json.dumps(definition, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
