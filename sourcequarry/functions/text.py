"""Text functions as column expressions."""

from pyspark.sql import Column, functions as F

# Fixed value.
RESPONSE_RULE = "=" * 80


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def half(value: Column) -> Column:
    return F.shiftright(value, 1)


# --- hashes and encodings -------------------------------------------------------------

def query_hash(prompt: Column | str) -> Column:
    return F.sha2(_col(prompt), 256)


def short_hash(prompt: Column | str) -> Column:
    return F.substring(F.md5(_col(prompt)), 1, 8)


def encode_base64(content: Column | str) -> Column:
    """Base64 in one line; Spark's own function may wrap it, depending on the session."""
    return F.replace(F.base64(_col(content).cast("binary")), F.lit("\r\n"), F.lit(""))


def decode_base64(encoded: Column | str, on_error: str = "null") -> Column:
    """Text of a base64 value. Bad base64 or bad UTF-8 gives NULL (a cache miss), or with
    ``on_error="fail"`` ends the job."""
    clean = F.regexp_replace(_col(encoded), "[^A-Za-z0-9+/=]", "")
    decoded = F.try_validate_utf8(F.try_to_binary(clean, F.lit("base64")).cast("string"))
    if on_error == "null":
        return decoded
    problem = F.raise_error(F.concat(F.lit("Failed to decode content: "), F.substring(_col(encoded), 1, 80)))
    return F.when(decoded.isNotNull() | _col(encoded).isNull(), decoded).otherwise(problem)


# --- truncation -----------------------------------------------------------------------

def truncate_middle(text: Column | str, max_length: int = 4000, mode: str = "intended") -> Column:
    """Keep both ends of a long text around a note on what is missing.

    In a text over twice the limit the first cut would start before the text. The
    reference then counts that start from the end (and repeats text); the intended
    reading starts the cut at 0.
    """
    s = _col(text)
    n = F.length(s)
    excess = n - max_length
    start = F.lit(max_length // 2) - half(excess)
    if mode == "reference":
        kept_before = F.when(start >= 0, start).otherwise(F.greatest(n + start, F.lit(0)))
        end = start + excess
    else:
        kept_before = F.greatest(start, F.lit(0))
        end = kept_before + excess
    missing = F.substring(s, kept_before + 1, F.greatest(end - kept_before, F.lit(0)))
    note = F.concat(
        F.lit(" ... TRUNCATED "), _newlines(missing).cast("string"),
        F.lit(" LINES AND "), excess.cast("string"), F.lit(" CHARACTERS ... "),
    )
    shortened = F.concat(F.substring(s, F.lit(1), kept_before), note, F.substring(s, end + 1, n))
    return F.when(n <= max_length, s).otherwise(shortened)


def last_newline(text: Column) -> Column:
    """1-based position of the last newline, 0 without one."""
    after = F.substring_index(text, "\n", -1)
    return F.when(F.contains(text, F.lit("\n")), F.length(text) - F.length(after)).otherwise(F.lit(0))


# --- lists, maps, lines ---------------------------------------------------------------

def format_list(items: Column | str) -> Column:
    """Sorted and comma-joined; ``None`` when empty or missing."""
    a = _col(items)
    return F.when(F.size(a) > 0, F.array_join(F.sort_array(a.cast("array<string>")), ", ")).otherwise(F.lit("None"))


def format_pairs(pairs: Column | str, key: str = "key", value: str = "value") -> Column:
    """``key: value`` of an array of structs, sorted by key; ``None`` when empty or missing."""
    a = _col(pairs)
    ordered = F.sort_array(F.transform(a, lambda p: F.struct(p[key].alias("k"), p[value].alias("v"))))
    texts = F.transform(ordered, lambda p: F.concat(p["k"].cast("string"), F.lit(": "), p["v"].cast("string")))
    return F.when(F.size(a) > 0, F.array_join(texts, ", ")).otherwise(F.lit("None"))


def format_dict(entries: Column | str) -> Column:
    return format_pairs(F.map_entries(_col(entries)))


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column | str) -> Column:
    """Newlines + 1."""
    return (_newlines(_col(text)) + 1).cast("long")


def strip(text: Column | str) -> Column:
    """Without white space at both ends (any Unicode white space, not only blanks)."""
    space = r"[\s\x1c-\x1f]+"
    return F.regexp_replace(_col(text), rf"(?U)^{space}|{space}\z", "")


def source_lines(raw_code: Column | str, mode: str = "intended") -> Column:
    """Lines of a source text. The reference also breaks at form feeds and the like."""
    line_break = "\n" if mode == "intended" else "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
    return F.split(_col(raw_code), line_break, -1)


def node_source(lines: Column | str, lineno: Column | str, end_lineno: Column | str) -> Column:
    """Source of a node, from the lines of its file."""
    first = _col(lineno)
    return F.array_join(F.slice(_col(lines), first, _col(end_lineno) - first + 1), "\n")


# --- names and paths ------------------------------------------------------------------

def file_name(rel_path: Column | str) -> Column:
    return F.substring_index(_col(rel_path), "/", -1)


def relative_path(path: Column | str, root: Column | str) -> Column:
    """``path`` below ``root``; a path outside stays as it is."""
    p = _col(path)
    base = F.regexp_replace(_col(root), "/+$", "")
    inside = F.startswith(p, F.concat(base, F.lit("/")))
    below = F.substring(p, F.length(base) + 2, F.length(p))
    return F.when(p == base, F.lit(".")).when(inside, below).otherwise(p)


def parent_scope(scope: Column | str) -> Column:
    """All but the last dotted segment; empty for a single segment."""
    parts = F.split(_col(scope), "[.]")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".")


def qualified_name(scope: Column | str, name: Column | str) -> Column:
    s, n = _col(scope), _col(name)
    return F.when(s == "<module>", n).otherwise(F.concat(s, F.lit("."), n))


def import_to_path(target: Column | str) -> Column:
    """``a.b`` to ``a/b.py``. A target with a leading dot is no path of the repository."""
    return F.concat(F.replace(_col(target), F.lit("."), F.lit("/")), F.lit(".py"))


# --- time -----------------------------------------------------------------------------

def format_timestamp(ts: Column | str, with_micros: bool = False) -> Column:
    return F.date_format(_col(ts), "yyyyMMdd_HHmmss_SSSSSS" if with_micros else "yyyyMMdd_HHmmss")


def iso_timestamp(ts: Column | str) -> Column:
    """ISO text; microseconds only when there are any."""
    t = _col(ts)
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(t, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def parse_iso_timestamp(text: Column | str) -> Column:
    return F.to_timestamp_ntz(_col(text))


def log_name(ts: Column | str, query_type: Column | str, prompt: Column | str, part: str = "prompt") -> Column:
    return F.concat(
        format_timestamp(ts), F.lit("_"), _col(query_type), F.lit("_"), short_hash(prompt), F.lit(f"_{part}.txt")
    )


def interaction_name(ts: Column | str) -> Column:
    return F.concat(F.lit("llm_interaction_"), format_timestamp(ts, with_micros=True), F.lit(".txt"))


# --- prompts and conversations --------------------------------------------------------

def fill_template(template: str, values: dict[str, Column]) -> Column:
    """The template's text with columns in place of ``{names}``. The template is cut up
    once, so braces inside a value stay as they are."""
    import string

    pieces = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(F.coalesce(values[name].cast("string"), F.lit("None")))
    return F.concat(*pieces)


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), _col(content).alias("content"))


def conversation_text(messages: Column | str) -> Column:
    """``role: content`` lines: the text a conversation is cached under."""
    return F.array_join(F.transform(_col(messages), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def interaction_text(prompt: Column | str, response: Column | str) -> Column:
    """The text document of one answered prompt."""
    return F.concat(
        F.lit("PROMPT:\n"), _col(prompt),
        F.lit(f"\n\n{RESPONSE_RULE}\nRESPONSE:\n{RESPONSE_RULE}\n\n"), _col(response), F.lit("\n"),
    )
