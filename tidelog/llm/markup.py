"""Wiki and HTML markup: the shown text for word matching, and the prose for language."""

from __future__ import annotations

import html
import re

COMMENT = re.compile(r"<!--.*?-->", re.S)
#: Tags within a word leave no gap; all others part words, and so do comments.
INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|small|big|sub|sup|span|font|nowiki|code|tt|del|ins|mark|abbr)\b[^<>]*>", re.I)
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
OUTER = re.compile(r"\[(?:https?:|ftp:|mailto:)?//[^\s\[\]]+[ \t]*([^\[\]]*)\]|\[(?:https?|ftp|mailto):[^\s\[\]]+[ \t]*([^\[\]]*)\]", re.I)
ATTRIBUTE = r"""[\w-]+[ ]?=[ ]?(?:"[^"\n]*"|'[^'\n]*')"""
#: Attributes of a table or row take its whole line, those of a cell stand before a single bar; what looks like them in a template is text.
TABLE_LINE = re.compile(rf"^([ \t:]*(?:\{{\||\|-))((?:[ \t]*{ATTRIBUTE})+)", re.M)
CELL = re.compile(rf"(^[ \t]*[|!]|\|\||!!)((?:[ \t]*{ATTRIBUTE})+)[ \t]*\|(?!\|)", re.M)
QUOTES = re.compile(r"'{2,}")
HIDDEN = re.compile("[­᠎​-‏‪-‮⁠-⁤﻿]")


def plain(text: str) -> str:
    """The text as shown, with words of templates and tables: links as their shown words, no comments, tags, attributes, bold or italic marks, entities resolved."""
    if "<" in text:
        if "<!--" in text:
            text = COMMENT.sub(" ", text)
        text = TAG.sub(" ", INLINE.sub("", text))
    if "[" in text:
        while True:  # links may hold links, as in captions
            text, n = LINK.subn(r"\1", text)
            if not n:
                break
        if "://" in text or ":" in text:
            text = OUTER.sub(lambda m: m[1] or m[2] or "", text)
    if "''" in text:
        text = QUOTES.sub("", text)
    if "=" in text and ('"' in text or "'" in text):
        text = CELL.sub(r"\1 ", TABLE_LINE.sub(r"\1 ", text))
    if "&" in text:
        text = html.unescape(text)
    return HIDDEN.sub("", text)


REFERENCE = re.compile(r"<ref\b[^<>]*?/\s*>|<ref\b[^<>]*>.*?</ref\s*>", re.I | re.S)
BLOCK = re.compile(r"<(math|code|pre|syntaxhighlight|source|gallery|timeline|score)\b[^<>]*>.*?</\1\s*>", re.I | re.S)
TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
TABLE = re.compile(r"\{\|(?:(?!\{\|).)*?\|\}", re.S)
ARGUMENT = re.compile(r"\{\{\{[^{}]*\}\}\}")
NOT_SHOWN = re.compile(r"\[\[[ :]*[^\W\d_]+(?: [^\W\d_]+)?:[^\[\]]*\]\]")
#: Lines that are not prose: headings, redirects, rows of broken tables, template arguments, rules, indented code.
NO_PROSE = re.compile(r"^\s*(?:=.*=\s*$|#\s*[A-Za-zА-Яа-яÀ-ÿ]+:?\s*\[\[|[|!{}]|-{4,}|__[A-Z]+__).*", re.M)


def prose(text: str) -> str:
    """What is left of the text without templates, tables, references, headings, redirects, categories and files."""
    if "<" in text:
        if "<!--" in text:
            text = COMMENT.sub("", text)
        if "<ref" in text or "<REF" in text or "<Ref" in text:
            text = REFERENCE.sub(" ", text)
        text = BLOCK.sub("\n", text)
    if "{" in text:
        if "{{{" in text:
            text = ARGUMENT.sub(" ", text)
        while True:
            text, n = TEMPLATE.subn(" ", text)
            if not n:
                break
        while True:
            text, n = TABLE.subn("\n", text)
            if not n:
                break
    text = NO_PROSE.sub("", text)
    if "[[" in text:
        text = NOT_SHOWN.sub(" ", text)
    return plain(text)
