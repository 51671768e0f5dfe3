"""Generated exemplars of each structural kind, from which the profiles of ``quality`` start.

Words are invented from syllables, so that only structure is stated here: how
prose, lists, tables, code and texts without content are laid out.
"""

from __future__ import annotations

import random
import re

from skein.llm.lexicon import FUNCTION_WORDS

_ONSET, _VOWEL, _CODA = "b c d f g l m n p r s t v br cl dr st tr pl sh th".split(), "a e i o u ea ou io".split(), ["", "", "n", "r", "s", "l", "t", "m", "nd"]
_CYRILLIC = ("б в д к л м н п р с т".split(), "а е и о у я".split(), ["", "", "н", "р", "т", "к"])
_LINKS = "Home|About|Contact|Login|Sign up|Search|Terms|Privacy|Next|Previous|Back|Help|Share|Print|Menu|Read more|Subscribe|Cookies|Sitemap|Download|Register|Cart (0)|Skip to content|Accept all".split("|")


class Writer:
    def __init__(self, seed: int, lang: str = "en"):
        self.r = random.Random(seed)
        self.lang = lang
        self.short = FUNCTION_WORDS[lang]
        self.odds = [1 / (k + 3) for k in range(len(self.short))]

    def word(self) -> str:
        onset, vowel, coda = _CYRILLIC if self.lang == "ru" else (_ONSET, _VOWEL, _CODA)
        return "".join(self.r.choice(onset) + self.r.choice(vowel) for _ in range(self.r.choice((1, 2, 2, 2, 3)))) + self.r.choice(coda)

    def name(self) -> str:
        return self.word().capitalize()

    def words(self, n: int, share: float) -> list[str]:
        return [self.r.choices(self.short, self.odds)[0] if self.r.random() < share else self.word() for _ in range(n)]

    def sentence(self, least: int = 7, most: int = 20) -> str:
        w = self.words(self.r.randint(least, most), 0.45)
        if self.r.random() < 0.5:
            w[len(w) // 2] += ","
        if self.r.random() < 0.15:
            w[-2] = str(self.r.randint(2, 1999))
        return w[0].capitalize() + " " + " ".join(w[1:]) + self.r.choices(".?!", (12, 1, 0.5))[0]

    def text(self, n: int) -> str:
        return " ".join(self.sentence() for _ in range(n))

    def phrase(self) -> str:
        shape = self.r.randint(0, 4)
        if shape == 0:
            return self.word()
        if shape == 1:
            return f"{self.word()} {self.short[0]} {self.name()}"
        if shape == 2:
            return f"{self.name()}, {self.word()}"
        return " ".join(self.words(self.r.randint(2, 4), 0.1))

    def number(self) -> str:
        return self.r.choice((str(self.r.randint(2, 999)), f"{self.r.uniform(1, 99):.2f}", f"{self.r.uniform(1, 99):.1f}", "-", ""))


def _prose(w: Writer, n: int) -> list[str]:
    r = w.r
    speaker = r.choice(("User", "Assistant", "Q", "A", w.name()))
    few = [f"- {w.phrase()}" for _ in range(3)]
    cells = ["|".join((" " + w.word(), w.number(), w.number())) for _ in range(3)]
    lines = [w.text(1)[:-1].rstrip(".?!") for _ in range(n * 2)]
    verse, running = [[], []], w.text(n + 2).split()
    while running:
        k = r.choice((4, 5, 6))
        verse[0].append(" ".join(running[:k]) + ("," if r.random() < 0.3 else ""))
        running = running[k:]
    verse[1] = [x[0].upper() + x[1:] for x in verse[0]]
    wrapped, held = [], ""
    for word in w.text(n).split():
        held = f"{held} {word}".strip()
        if len(held) > 62:
            wrapped, held = [*wrapped, held], ""
    return [
        w.text(n),
        w.text(1),
        " ".join(w.phrase().capitalize() for _ in range(1)) + "\n\n" + w.text(n),
        "\n\n".join(w.text(3) for _ in range(max(2, n // 3))),
        "\n\n".join(f"{s}: {w.text(2)}" for s in (speaker, "Assistant") * max(1, n // 3)),
        "\n".join(f"{s}: {w.text(1)}" for s in ("Human", "AI") * max(2, n // 2)),
        "\n".join(" ".join(w.words(6, 0.42)).capitalize() + r.choice((",", "", ".", ";")) for _ in range(n + 4)),
        "\n".join(" ".join(x.split()[:7]) for x in lines[:n]),
        "\n".join([*wrapped, held]),
        "\n".join(verse[0]),
        "\n\n".join("\n".join(verse[1][i : i + 4]) for i in range(0, len(verse[1]), 4)),
        w.text(n + 4) + "\n\n" + "\n".join(few) + "\n\n" + w.text(n),
        w.text(n + 4) + "\n\n" + "\n".join(cells) + "\n\n" + w.text(n),
        '"' + w.text(n) + '" ' + w.text(2),
        re.sub(r"[^\w ]", "", w.text(n)).lower(),
    ]


def _list(w: Writer, n: int) -> list[str]:
    out = []
    marks = [lambda i: "- ", lambda i: "* ", lambda i: "• ", lambda i: f"{i}. ", lambda i: f"{i}) ", lambda i: f"{chr(97 + i % 26)}) ", lambda i: f"({i}) ", lambda i: "[ ] ", lambda i: "+ ", lambda i: "– ", lambda i: "  - "]
    for k, mark in enumerate(marks):
        rows = [mark(i) + w.phrase() for i in range(1, n + 6)]
        out.append("\n".join(rows))
        out.append(f"{w.name()} {w.short[1]} {w.name()}\n\n" + "\n".join(rows))
        out.append((f"{w.name()} {w.word()}\n\n" if k % 2 else "") + "\n".join(mark(i) + w.sentence() for i in range(1, n + 3)))
    for _ in range(3):
        bare = "\n".join(w.phrase() for _ in range(n + 6))
        out += [bare, f"{w.name()} {w.word()}\n\n{bare}", "\n".join(w.phrase().capitalize() for _ in range(n + 6))]
    return out


def _table(w: Writer, n: int) -> list[str]:
    out = []
    for columns in (2, 3, 4, 6):
        for words in (False, True):
            head = [w.word() for _ in range(columns)]
            rows = [[w.name(), *((w.word() if words and w.r.random() < 0.5 else w.number()) for _ in range(columns - 1))] for _ in range(n + 3)]
            plain = [head, *rows]
            shapes = [
                "\n".join("| " + " | ".join(x) + " |" for x in [head, ["---"] * columns, *rows]),
                "\n".join("\t".join(x) for x in plain),
                "\n".join(";".join(x) for x in plain),
                "\n".join(",".join(x) for x in plain),
                "\n".join(" | ".join(x) for x in plain),
                "\n".join("".join(c.ljust(14) for c in x).rstrip() for x in plain),
                "\n".join("<tr>" + "".join(f"<td>{c}</td>" for c in x) + "</tr>" for x in plain),
            ]
            out += shapes if columns > 2 else shapes[:2] + shapes[4:]
            if words:
                out += [f"Table {w.r.randint(1, 9)}. {w.name()} {w.word()}\n{x}" for x in shapes[::2]]
    return out


def _code(w: Writer, n: int) -> list[str]:
    v = lambda: w.word()
    python, script, shell, query = ["import " + v(), ""], [], ["#!/bin/sh", "set -e"], []
    for i in range(max(2, n // 3)):
        a, b, c = v(), v(), v()
        python += [f"def {a}_{b}({c}, {v()}={i}):", f'    """{w.sentence(4, 8)}"""', f"    {b} = []", f"    for i, x in enumerate({c}):", f"        if x % {i + 2} == 0:", f"            {b}.append(x * {i + 3})", "        # " + " ".join(w.words(4, 0.4)), f"    return {b}", ""]
        script += [f"function {a}({b}, {c}) {{", f"  const {v()} = {b}.map((x) => x + {i});", f"  if ({b}.length > {i}) {{", f"    return {c}[{i}];", "  }", f"  // {w.sentence(3, 6)}", f"  return {v()}({c});", "}", ""]
        shell += [f"{a}=$({b} -{c[0]} \"${c}\")", f'if [ -f "${a}" ]; then', f"  cp ${a} /tmp/{b}.txt", "fi"]
        query += [f"SELECT {a}.{b}, COUNT({c}) AS n", f"FROM {a}", f"JOIN {v()} ON {a}.id = {b}.id", f"WHERE {c} > {i}", f"GROUP BY {a}.{b};"]
    cls = [f"class {w.name()}:", "    def __init__(self, " + v() + "):", f"        self.{v()} = {v()}", "", f"    def {v()}(self):", f"        return self.{v()}.{v()}({v()})", ""] * 2
    c_like = ["#include <stdio.h>", "", "int main(void) {", f"    int {v()} = 0;", f"    for (int i = 0; i < 10; i++) {{ {v()}[i] += {v()}; }}", f'    printf("%d\\n", {v()});', "    return 0;", "}"] * 2
    return ["\n".join(x) for x in (python, script, shell, query, cls, c_like, python + cls, [f'"""{w.sentence()}"""', *python])]


def _junk(w: Writer, n: int) -> list[str]:
    r = w.r
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    symbols, base, hexes = "!#$%&*+-/<=>@[]^_{|}~\\", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"
    broken = "Ã©Â°â€™¿¶�Ÿœ"
    size = 12 * n + 60
    one, two = w.word(), w.word()
    said = w.sentence()
    links = lambda k: [r.choice(_LINKS) for _ in range(k)]
    keys = [w.word() for _ in range(4 + n)]
    return [
        "".join(" " if r.random() < 0.03 else r.choice(symbols) for _ in range(size)),
        " ".join(pick("bcdfghjklmnpqrstvwxz", r.randint(2, 10)) for _ in range(n * 4)),
        " ".join(pick("abcdefghijklmnopqrstuvwxyz", r.randint(2, 10)) for _ in range(n * 4)),
        "\n".join(pick(base, 64) for _ in range(max(2, n // 2))),
        pick(base, size),
        pick(hexes, size),
        "\n".join(pick(hexes, 32) for _ in range(n)),
        " ".join(pick(broken, r.randint(1, 6)) for _ in range(n * 5)),
        pick(broken, size),
        " | ".join(links(n + 6)), " :: ".join(links(n + 6)), " > ".join(links(n + 6)), "\n".join(links(n + 6)), " ".join(links(n + 6)), " · ".join(links(n + 6)),
        " ".join(r.choice(keys) for _ in range(n * 8)), ", ".join(r.choice(keys) for _ in range(n * 8)), " ".join(w.word() for _ in range(n * 6)), " ".join(w.words(n * 6, 0.02)),
        ", ".join(w.word() for _ in range(n * 6)),
        " ".join([one] * (n * 6)), ", ".join([one] * (n * 6)), " ".join([one, two] * (n * 4)), "\n".join([one] * (n * 4)),
        " ".join([said] * (n + 4)), "\n".join([said] * (n + 4)), (one + ". ") * (n * 4),
        pick("a", 1) * size, "=-" * (size // 2), "." * size, "\n".join(["*" * 40] * n),
    ]


_KINDS = {"prose": _prose, "list": _list, "table": _table, "code": _code, "junk": _junk}


def exemplars(seed: int = 11) -> list[tuple[str, str, str]]:
    """``(kind, layout, text)``; each layout in several lengths, prose and lists in every language."""
    out = []
    for kind, write in _KINDS.items():
        for lang in sorted(FUNCTION_WORDS) if kind in ("prose", "list") else ["en"]:
            for n in (4, 8, 20):
                w = Writer(seed + n, lang)
                out += [(kind, f"{kind}-{k}", text) for k, text in enumerate(write(w, n))]
    return out
