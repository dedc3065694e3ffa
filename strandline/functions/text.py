"""Text, URL and address expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns for extraction and indicators.
IPV4 = r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b"
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
HASH = r"(?i)\b(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,6}\b"
URL = r"(?i)\bhttps?://[^\s\"'<>`()\[\]{}]+"
HOST = r"(?i)\b([a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?){1,})\b"
WINDOWS_PATH = r"[A-Za-z]:\\(?:[^\\\s\"<>|?*]+\\)*[^\\\s\"<>|?*]+"
UNC_PATH = r"\\\\[A-Za-z0-9._-]+\\[^\s\"<>|?*]+"
UNIX_PATH = r"(?<![\w/:.])/(?:usr|etc|tmp|var|home|opt|bin|root|dev|proc)/[^\s\"'<>|;]+"
REGISTRY = r"(?i)\b(?:HKEY_[A-Z_]+|HK(?:LM|CU|CR|U|CC))\\[^\s\"]+"
MAC = r"(?i)\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b"


def refang(c: Column) -> Column:
    """Written-around indicators as they are meant: ``hxxp``, ``[.]``, ``(dot)``, ``[:]``, ``[@]``, ``[://]``."""
    for pattern, to in ((r"(?i)\bh(?:xx|\*\*)p(s?)", "http$1"), (r"\[://\]", "://"), (r"\[:\]", ":"), (r"(?i)\[\.\]|\(\.\)|\[dot\]|\(dot\)", "."), (r"(?i)\[@\]|\[at\]|\(at\)", "@")):
        c = F.regexp_replace(c, pattern, to)
    return c


def csv_cell(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike(r'[",\r\n]'), quoted).otherwise(c)


def html_text(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def byte_size(n: Column) -> Column:
    """``512 B``, ``1.5 KB`` and so on, one decimal."""
    scaled = lambda d, u: F.concat(F.format_number(n / d, 1), F.lit(u))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1024, " KB")).when(n < 1024**3, scaled(1024**2, " MB")).otherwise(scaled(1024**3, " GB"))


def url_host(url: Column) -> Column:
    """Lower-cased host of a URL, without user, port and brackets; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?\[?([^/?#:\]]+)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def safe_link(url: Column) -> Column:
    """The target of a mail gateway's rewritten link (Microsoft, Proofpoint v1-v3); the URL itself otherwise."""
    decode = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    microsoft = decode(F.regexp_extract(url, r"(?i)^https?://[a-z0-9]+\.safelinks\.protection\.outlook\.com/?\?(?:[^#]*&)?url=([^&#]+)", 1))
    coded = F.regexp_extract(url, r"(?i)^https?://urldefense\.proofpoint\.com/v[12]/url\?(?:[^#]*&)?u=([^&#]+)", 1)
    older = decode(F.translate(coded, "-_", "%/"))
    starred = F.regexp_extract(url, r"(?i)^https?://urldefense\.com/v3/__(.+?)__;", 1)
    newer = decode(F.regexp_replace(F.replace(starred, F.lit("%"), F.lit("%25")), r"\*([0-9A-Fa-f]{2})", "%$1"))
    hit = F.coalesce(*[F.nullif(x, F.lit("")) for x in (microsoft, older, newer)], url)
    return F.when(url.rlike(r"(?i)^https?://(?:urldefense\.|[a-z0-9]+\.safelinks\.)"), hit).otherwise(url)


def numeric_host(host: Column) -> Column:
    """Hosts of one to four decimal, hex or octal numbers as dotted quads, the last number filling the rest; others unchanged."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  # a value that is used often is not written out again
    number = lambda p: F.when(p.startswith("0x"), F.conv(F.substring(p, 3, 8), 16, 10)).when(p.rlike("^0[0-7]"), F.conv(p, 8, 10)).otherwise(p).try_cast("long")
    quad = lambda whole: F.concat_ws(".", *[F.shiftright(whole, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])

    def joined(values: Column) -> Column:
        n, last = F.size(values), F.element_at(values, -1)
        head = F.slice(values, 1, n - 1)
        front = F.aggregate(head, F.lit(0).cast("long"), lambda a, v: a * 256 + v)
        room = F.element_at(F.array(*[F.lit(1 << 8 * k) for k in (4, 3, 2, 1)]), n)
        fits = F.forall(head, lambda v: v.between(0, 255)) & last.between(0, room - 1)
        return F.when(fits, once(front * room + last, quad))

    shaped = host.rlike(r"(?i)^(?:0x[0-9a-f]{1,8}|0[0-7]{0,11}|[1-9]\d{0,9})(?:\.(?:0x[0-9a-f]{1,8}|0[0-7]{0,11}|[1-9]\d{0,9})){0,3}$")
    read = once(F.transform(F.split(F.lower(host), r"\."), number), joined)
    return F.when(shaped, F.coalesce(read, host)).otherwise(host)


#: Escapes of one code point or more: runs of four-digit units, with surrogates in pairs; braces; two digits.
_ESCAPES = r"(?:\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})+|\\u\{(?:10[0-9a-fA-F]{4}|0?[1-9a-fA-F][0-9a-fA-F]{4}|0{0,2}(?![dD][89a-fA-F][0-9a-fA-F]{2}\})[0-9a-fA-F]{1,4})\}|\\x[0-9a-fA-F]{2}"
ESCAPE_PASSES = 3


def _unescaped(c: Column) -> Column:
    """One pass over a text: what stands between escapes, and these decoded."""
    digits = lambda m, mark: F.unhex(F.replace(m, F.lit(mark), F.lit("")))
    point = lambda m: F.unhex(F.lpad(F.regexp_extract(m, r"([0-9a-fA-F]+)", 1), 8, "0"))
    plain = F.transform(
        F.regexp_extract_all(c, F.lit(_ESCAPES), F.lit(0)),
        lambda m: F.when(m.startswith("\\x"), F.decode(digits(m, "\\x"), "ISO-8859-1")).when(m.startswith("\\u{"), F.decode(point(m), "UTF-32")).otherwise(F.decode(digits(m, "\\u"), "UTF-16BE")),
    )
    return F.array_join(F.zip_with(F.split(c, _ESCAPES, -1), plain, lambda between, m: F.concat(between, F.coalesce(m, F.lit("")))), "")


def decoded_escapes(c: Column) -> Column:
    r"""``\\xNN``, ``\\uNNNN`` and ``\\u{N}`` of any code point, escapes of escapes up to three deep, then percent triplets, decoded.

    A malformed triplet, half of a surrogate pair and a number that is no code point stay as they are.
    """
    marked = F.when(F.contains(c, F.lit("\\")), F.aggregate(F.sequence(F.lit(1), F.lit(ESCAPE_PASSES)), c, lambda text, _: _unescaped(text))).otherwise(c)
    text = F.replace(marked, F.lit("+"), F.lit("%2B"))
    alone = F.try_url_decode(F.regexp_replace(text, r"%(?![0-7][0-9A-Fa-f])", "%25"))
    return F.when(F.contains(marked, F.lit("%")), F.coalesce(F.try_url_decode(text), alone, marked)).otherwise(marked)


def normal_url(url: Column) -> Column:
    """Escapes and numeric hosts undone in host and path; the query is left alone."""
    query = F.regexp_extract(url, r"([?#].*)$", 1)
    front = decoded_escapes(F.regexp_extract(url, r"^([^?#]*)", 1))
    host = F.regexp_extract(front, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:]+)", 1)
    quad = numeric_host(host)
    return F.concat(F.when((host != "") & (quad != host), F.replace(front, F.concat(F.lit("://"), host), F.concat(F.lit("://"), quad))).otherwise(front), query)


def _entropies(texts: pa.Array) -> list[float]:
    """Of each text, from counts of its code points over the batch's alphabet."""
    texts = texts.fill_null("")
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    out = []
    for begin, end in zip((ends - sizes).tolist(), ends.tolist()):
        part = points[begin:end]
        counts = np.bincount(part) if len(part) and part.max() < 65536 else np.unique(part, return_counts=True)[1]
        p = counts[counts > 0] / max(len(part), 1)
        out.append(float(-(p * np.log2(p)).sum()) + 0.0)
    return out


@F.arrow_udf(T.DoubleType())
def _entropy(texts: pa.Array) -> pa.Array:
    return pa.array(_entropies(texts), pa.float64())


def entropy(c: Column) -> Column:
    """Shannon entropy in bits a character, 0 for the empty text and null: one pass over each text, in Arrow batches."""
    return _entropy(c)


def formula_risk(c: Column) -> Column:
    """Cells that a spreadsheet would run: none, low (starts like a formula) or critical (and calls out)."""
    starts = c.rlike(r"^\s*[=+\-@]") & ~c.rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$")
    return F.when(starts & c.rlike(r"(?i)\b(?:cmd|powershell|mshta|rundll32|hyperlink|webservice|dde)\b"), "critical").when(starts, "low").otherwise("none")


def pairs_map(c: Column) -> Column:
    """``k=v | k=v`` as a map; the last of equal keys wins, parts without a key go."""
    parts = F.filter(F.split(c, r" \| "), lambda p: p.rlike(r"^[^=]{1,59}="))
    keys, values = F.transform(parts, lambda p: F.regexp_extract(p, r"^([^=]+)=", 1)), F.transform(parts, lambda p: F.regexp_extract(p, r"(?s)^[^=]+=(.*)$", 1))
    last = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("k"), F.element_at(values, F.size(values) - F.array_position(F.reverse(keys), k).cast("int") + 1).alias("v")))
    return F.map_from_entries(last)


def channel_name(c: Column) -> Column:
    """Short names of event log channels."""
    low = F.lower(c)
    out = F.when(low.contains("sysmon"), "Sysmon").when(low.contains("powershell"), "PowerShell").when(low.contains("defender"), "Defender").when(low.contains("taskscheduler"), "TaskScheduler")
    return out.when(low.contains("terminalservices"), "TerminalServices").when(low == "security", "Security").when(low == "system", "System").when(low == "application", "Application").otherwise(c)


def priority(pri: Column) -> Column:
    """(severity, facility) names of a syslog priority, null outside 0..191."""
    names = lambda words: F.array(*map(F.lit, words))
    p = pri.try_cast("int")
    fits = p.between(0, 191)
    return F.struct(
        F.when(fits, F.get(names(SEVERITIES), p.bitwiseAND(7))).alias("severity"), F.when(fits, F.get(names(FACILITIES), F.shiftright(p, 3))).alias("facility")
    )


#: Syslog severities and facilities by number.
SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")
FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "audit", "alert", "clock", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7")
