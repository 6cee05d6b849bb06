"""Texts shown to users: errors, details, counts, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sizes import byte_label, savings_label

#: Error codes with their messages; %s stands for the file's name, extension or format.
MESSAGES = {
    "cannotOpen": "Couldn't open “%s”.",
    "notAPDF": "“%s” isn't a readable PDF.",
    "wrongPassword": "Incorrect password.",
    "notEncrypted": "This PDF has no password.",
    "unsupportedInput": "“%s” files aren't supported here.",
    "unsupportedOutput": "This Mac can't write %s files.",
    "decodeFailed": "Couldn't decode the image data in “%s”.",
    "encodeFailed": "Failed to encode %s data.",
    "writeFailed": "Couldn't write to “%s”.",
    "invalidDimensions": "Enter a width or a height greater than zero.",
    "noGain": "Already optimized — the original was smaller.",
}
#: What to do about an error, for the codes that have such a hint.
HINTS = {
    "wrongPassword": "Check the password and try again. It is case-sensitive.",
    "notEncrypted": "You can open and save it normally — nothing to remove.",
    "noGain": "The original file was copied unchanged.",
}


def error_message(code: Column, subject: Column) -> Column:
    """The message of a code with its subject filled in; null for unknown codes."""
    table = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return F.replace(F.element_at(table, code), F.lit("%s"), F.coalesce(subject, F.lit("")))


def recovery_hint(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair]), code)


def counted(n: Column, noun: str) -> Column:
    """`1 file`, `2 files`."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def convert_detail(name: Column, original: Column, new: Column) -> Column:
    return F.concat_ws(" · ", name, savings_label(original, new))


def compress_detail(kept: Column, original: Column, new: Column) -> Column:
    same = F.concat(F.lit("Already optimal — copied unchanged ("), byte_label(original), F.lit(")"))
    return F.when(kept, same).otherwise(savings_label(original, new))


def resize_detail(width: Column, height: Column, new_width: Column, new_height: Column, original: Column, new: Column) -> Column:
    size = [c.cast("int").cast("string") for c in (width, height, new_width, new_height)]
    return F.concat(size[0], F.lit("×"), size[1], F.lit(" → "), size[2], F.lit("×"), size[3], F.lit(" px · "), savings_label(original, new))


def unlock_detail(pages: Column, name: Column) -> Column:
    return F.concat(F.lit("Unlocked · "), counted(pages, "page"), F.lit(" → "), name)


def summary(done: Column, failed: Column) -> Column:
    """One line about a batch."""
    return (
        F.when(failed == 0, F.concat(F.lit("Done — "), counted(done, "file")))
        .when(done == 0, F.concat(F.lit("Failed — "), counted(failed, "file")))
        .otherwise(F.concat(done.cast("string"), F.lit(" done, "), failed.cast("string"), F.lit(" failed")))
    )


def whole_number(text: Column, default: int | None = None) -> Column:
    """The text as an integer, else the default: no spaces, no fractions."""
    number = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))
    return number if default is None else F.coalesce(number, F.lit(default).cast("long"))


def html_escape(text: Column) -> Column:
    """The text with & < > and double quotes as references, & first."""
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(reference))
    return text


def filled(template: Column, values: dict[str, Column]) -> Column:
    """The template with `__NAME__` replaced for each name."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"__{name}__"), value.cast("string"))
    return template
