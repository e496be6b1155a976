"""What is residue beyond doubt: unfilled placeholders, and well-known error and filler texts.

The patterns are seeds. Problem 7 learns from the records they mark what other residue reads like, and
problem 5 takes passages they mark as standing in place of an article.
"""

from __future__ import annotations

import re

#: An unfilled placeholder, in the notations of common template languages. Fixed values.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,80}\}\}|\{%[^%\n]{1,80}%\}|<%[^%\n]{1,80}%>|[$#]\{[^{}\n]{1,60}\}|\{[a-z][a-z0-9_.]{1,40}\}|%%[A-Z][A-Z_]{1,40}%%|(?<!\w)__[A-Z][A-Z_]{1,40}__(?!\w)|"
    r"\*\|[A-Z_]{2,40}\|\*|@@[\w.]{2,40}@@|\[\[[a-z_.]{2,40}\]\]|\[(?:INSERT|YOUR|ENTER|ADD)\b[^\]\n]{0,60}\]|<[a-z_ ]{2,40} goes here>|\bTBD:\s|\[object Object\]"
)
#: Parts of which a passage must hold one for PLACEHOLDER to match: cheap to look for.
_MARKS = ("{", "%", "<", "__", "*|", "@@", "[[", "[INSERT", "[YOUR", "[ENTER", "[ADD", "TBD", "[object")
#: Seeds by family: what servers and browsers say, what pages say that need scripts, filler, and what a reading
#: service says instead of the page. Each pattern stands beside parts of which its lower-cased match holds one. Fixed values.
FAMILIES: dict[str, tuple[tuple[tuple[str, ...], str], ...]] = {
    "errors": (
        (("page not found",), r"\bpage not found\b"),
        (("gone missing", "could not be found"), r"\bpage\b.{0,80}\b(?:has gone missing|could not be found)"),
        (("not available in your",), r"\bnot available in your (?:region|country)\b"),
        (("access denied",), r"\baccess denied\b"),
        (("session expired", "session has expired"), r"\bsession (?:has )?expired\b"),
        (("unavailable",), r"\bservice (?:is )?(?:temporarily )?unavailable\b"),
        (("moved or deleted",), r"\bmoved or deleted\b"),
        (("too many requests",), r"\btoo many requests\b"),
        (("fatal error",), r"\bfatal error:"),
        (("checking your browser",), r"\bchecking your browser\b"),
        (("browser is too old",), r"\bbrowser is too old\b"),
        (("seite nicht gefunden",), r"\bseite nicht gefunden\b"),
        (("page introuvable",), r"\bpage introuvable\b"),
        (("no existe", "no encontrada"), r"\bpágina (?:solicitada )?no (?:existe|encontrada)\b"),
        (("見つかりません",), r"ページ.{0,4}見つかりません"),
    ),
    "scripts": (
        (("javascript",), r"\bjavascript\b"),
        (("スクリプト",), r"スクリプト"),
        (("scripts",), r"\b(?:requires|allow|enable|activate) scripts\b"),
    ),
    "filler": (
        (("lorem ipsum",), r"\blorem ipsum\b"),
        (("asdf",), r"\basdf\b"),
        (("xxx xxx",), r"\bx{3,}(?: x{3,})+\b"),
        (("blindtext",), r"\bblindtext\b"),
        (("sample text",), r"\bsample text\b"),
        (("click to edit",), r"\bclick to edit\b"),
        (("text here",), r"\badd your\b.{1,40}\btext here\b"),
        (("tk tk",), r"\btk tk\b"),
    ),
    "reading": (
        (("[illegible]",), r"^\[illegible\]$"),
        (("unable to read", "unable to transcribe"), r"\bunable to (?:read|transcribe)\b"),
        (("too blurred",), r"\btoo blurred to\b"),
        (("here is the markdown",), r"\bhere is the markdown\b"),
        (("extracted text",), r"\bextracted text will\b"),
        (("model stopped",), r"\bthe model stopped\b"),
        (("page_content",), r"<page_content\s*/?>"),
        (('"error"',), r"^\{\s*\"error\""),
    ),
}
_QUOTED = re.compile(r"`[^`\n]*`|“[^”\n]*”|„[^“\n]*“|«[^»\n]*»|「[^」\n]*」|\"[^\"\n{}]{2,60}\"(?!\s*[:,}])")
MASK = "∎"


def is_quoting(text: str) -> bool:
    return any([q in text for q in "`“„«「\""])


def unquoted(passage: str) -> str:
    """``passage`` with its quoted and code-marked spans masked: what stands there is shown, not said."""
    return _QUOTED.sub(f" {MASK} ", passage) if is_quoting(passage) else passage


def may_hold_placeholder(text: str) -> bool:
    return any([c in text for c in _MARKS])


def has_placeholder(passage: str) -> bool:
    return may_hold_placeholder(passage) and PLACEHOLDER.search(passage) is not None


class Seeds:
    """The seeds of some families, each pattern behind the parts that its match must hold."""

    def __init__(self, families: tuple[str, ...] = tuple(FAMILIES)):
        self.patterns = [(parts, re.compile(p, re.I)) for f in families for parts, p in FAMILIES[f]]
        self._parts = [h for parts, _ in self.patterns for h in parts]

    def match(self, passage: str) -> bool:
        """Whether a passage with its quotations masked is a seed; a placeholder is one, beside quotations too."""
        if has_placeholder(passage):
            return True
        if MASK in passage:
            return False
        low = passage.lower()
        if not any([h in low for h in self._parts]):
            return False
        return any([any([h in low for h in parts]) and p.search(passage) is not None for parts, p in self.patterns])
