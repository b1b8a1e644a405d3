"""Text expressions over code and documentation. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace, line-break and word classes of Unicode strings.
# Regex engines differ on \s and \w, so they are spelled out.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_IN_LINE = r"[\t\x1f\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"([\p{L}\p{N}_]+)"

# Comment decoration removed from documentation, in this order.
COMMENT_DECORATION = (
    rf"(?dm)^{SPACE}*//+{SPACE}?",
    rf"(?dm)^{SPACE}*\*+{SPACE}?",
    r"/\*+=?",
    r"\*+/",
    rf"(?dm)^{SPACE}*#+{SPACE}?",
)

# The chat frame around a reranker prompt.
RERANK_PROMPT_PREFIX = (
    "<|im_start|>system\n"
    "Judge whether the Document meets the requirements based on the Query "
    'and the Instruct provided. Note that the answer can only be "yes" or "no".'
    "<|im_end|>\n"
    "<|im_start|>user\n"
)
RERANK_PROMPT_SUFFIX = "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def is_blank(text: Column) -> Column:
    """True for NULL, empty or whitespace-only text."""
    return F.coalesce(strip(text) == "", F.lit(True))


def non_empty(text: Column) -> Column:
    """Turn the empty string into NULL."""
    return F.when(text != "", text)


def words(text: Column) -> Column:
    """Lower-cased word tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def capitalize(text: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def collapse_blank_lines(text: Column) -> Column:
    """Three or more line feeds become two."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def universal_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def signature(code: Column, language: Column) -> Column:
    """Header of a definition: up to the first colon (Python) or brace (others)."""
    opener = F.when(language == "python", F.lit(":")).otherwise(F.lit("{"))
    at = F.instr(code, opener)
    kept = F.when(language == "python", at).otherwise(at - 1)
    header = F.when(at > 0, F.left(code, kept)).otherwise(F.substring_index(code, "\n", 1))
    return strip(header)


def clean_comment(text: Column) -> Column:
    """Strip comment decoration; empty results are NULL."""
    for pattern in COMMENT_DECORATION:
        text = F.regexp_replace(text, pattern, "")
    return non_empty(strip(text))


def identifier(class_name: Column, function_name: Column) -> Column:
    """``Class.function``, either part alone, or ``<anonymous>``."""
    joined = F.concat_ws(".", non_empty(class_name), non_empty(function_name))
    return F.coalesce(non_empty(joined), F.lit("<anonymous>"))


def structured_text(
    language: Column,
    entity_type: Column,
    class_name: Column,
    function_name: Column,
    signature_text: Column,
    docstring: Column,
    code: Column,
    include_docstring: bool = True,
) -> Column:
    """The text that is embedded for an entity or chunk."""
    function_name, class_name = non_empty(function_name), non_empty(class_name)
    unknown = F.lit("<unknown>")
    is_class = entity_type == "class"
    owner = F.when(
        is_class, F.concat(F.lit("Class: "), F.coalesce(function_name, class_name, unknown))
    ).when(class_name.isNotNull(), F.concat(F.lit("Class: "), class_name))
    member = F.when(
        ~is_class,
        F.concat(
            F.when(class_name.isNotNull(), F.lit("Method: ")).otherwise(F.lit("Function: ")),
            F.coalesce(function_name, unknown),
        ),
    )
    lines = [
        F.concat(F.lit("Language: "), capitalize(language)),
        owner,
        member,
        F.concat(F.lit("Signature: "), signature_text),
    ]
    if include_docstring:
        lines.append(F.concat(F.lit("Documentation: "), strip(non_empty(docstring))))
    lines += [F.lit("Code:"), code]
    return F.concat_ws("\n", *lines)


def blank_docstring(code: Column, docstring: Column) -> Column:
    """Replace the first occurrence of a docstring by ``''`` plus its line breaks."""
    at = F.instr(code, docstring)
    blanked = F.concat(
        F.left(code, at - 1),
        F.lit("''"),
        F.regexp_replace(docstring, r"[^\r\n]", ""),
        F.substr(code, at + F.length(docstring)),
    )
    return F.when((F.length(docstring) > 0) & (at > 0), blanked).otherwise(code)


def word_sequence(text: Column) -> Column:
    """Space-padded word tokens, so containment respects token boundaries."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def contains_documentation(code: Column, documentation: Column) -> Column:
    """True if the documentation's word sequence occurs in the code's."""
    return (F.size(words(documentation)) > 0) & F.contains(
        word_sequence(code), word_sequence(documentation)
    )


def normalize_code(code: Column) -> Column:
    """Whole text stripped, every line right-trimmed, LF line ends."""
    unified = F.regexp_replace(strip(code), LINE_BREAK, "\n")
    return F.regexp_replace(unified, rf"{SPACE_IN_LINE}+\n", "\n")


def dedup_key(language: Column, function_name: Column, code: Column) -> Column:
    """Content identity of a function; path, repository and documentation are left out."""
    parts = [
        F.coalesce(language, F.lit("")),
        F.coalesce(function_name, F.lit("")),
        normalize_code(F.coalesce(code, F.lit(""))),
    ]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def with_php_tag(code: Column, language: Column) -> Column:
    """Prefix PHP snippets that lack an opening tag."""
    tagged = F.startswith(strip(code), F.lit("<?"))
    return F.when((language == "php") & ~tagged, F.concat(F.lit("<?php\n"), code)).otherwise(code)


def rerank_prompt(
    query: Column,
    document: Column,
    instruction: str,
    language: Column | None = None,
) -> Column:
    """Instruction, query, optional language hint and document as one prompt body."""
    hint = F.lit("")
    if language is not None:
        sentence = F.concat(
            F.lit("The document is source code written in "), capitalize(language), F.lit(".\n")
        )
        hint = F.coalesce(F.when(language != "", sentence), F.lit(""))
    return F.concat(
        F.lit(f"<Instruct>: {instruction}\n<Query>: "), query, F.lit("\n"), hint,
        F.lit("<Document>: "), document,
    )
