"""RE2 patterns in the syntax of the engine that evaluates them.

Both dialects mean the same by most of what they share. What differs is
written otherwise: classes by name, brackets and && within classes, groups
by name, quoted text, braces that count nothing, word borders, line ends.
What RE2 lacks is refused, so that a pattern fails when it is given or not
at all; so is a repetition right behind flags.
"""

from __future__ import annotations

import re

#: Names of classes in brackets, in both dialects: fixed.
POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}",
    "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}

#: General categories by one or two letters; any other name of a property is a script.
CATEGORY = re.compile(r"C[cfos]?|L[lmotu]?|M[cen]?|N[dlo]?|P[cdefios]?|S[ckmo]?|Z[lps]?")

WORD = "[0-9A-Za-z_]"
BORDER = {"b": f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))", "B": f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"}
SPACES = r"\t\n\f\r "
SIMPLE = {"a": "\\x07", "f": "\\f", "t": "\\t", "n": "\\n", "r": "\\r", "v": "\\x0B"}
CLASSES = {"d": r"\d", "D": r"\D", "w": r"\w", "W": r"\W", "s": f"[{SPACES}]", "S": f"[^{SPACES}]"}
MOST_REPEATS = 1000

COUNT = re.compile(r"\{(\d+)(,(\d*))?\}")
NAMED = re.compile(r"\(\?P?<(\w+)>", re.ASCII)
FLAGS = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])")
PROPERTY = re.compile(r"\\([pP])(?:\{(\^?)(\w+)\}|(\w))")
NUMBER = re.compile(r"\\x(?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2}))|\\(0[0-7]{0,2}|[1-7][0-7]{1,2})")


class BadPattern(ValueError):
    """A pattern that RE2 doesn't accept."""


def literal(char: str) -> str:
    return char if char.isalnum() or char in " _/" or ord(char) > 127 else f"\\x{ord(char):02X}"


class Translation:
    """One pattern on the way from the first dialect to the second."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.out = text, 0, []

    def fail(self, why: str) -> BadPattern:
        return BadPattern(f"bad regular expression {self.text!r}: {why}")

    def take(self, form: re.Pattern) -> re.Match | None:
        if found := form.match(self.text, self.at):
            self.at = found.end()
        return found

    def escape(self) -> tuple[str | None, str]:
        """What an escape stands for, inside a class or out: (the character, if it is one; its new form)."""
        if found := self.take(PROPERTY):
            sign, inverse, name = found[1], found[2] or "", found[3] or found[4]
            sign = {"p": "P", "P": "p"}[sign] if inverse else sign
            if name == "Any":
                return None, f"[{'' if sign == 'p' else '^'}\\x00-\\x{{10FFFF}}]"
            return None, f"\\{sign}{{{name if CATEGORY.fullmatch(name) else f'Is{name}'}}}"
        if found := self.take(NUMBER):
            code = int(found[1] or found[2], 16) if found[1] or found[2] else int(found[3], 8)
            if code > 0x10FFFF:
                raise self.fail("a character beyond the last one")
            return chr(code), f"\\x{{{code:X}}}"
        char = self.text[self.at + 1 : self.at + 2]
        self.at += 2
        if char in SIMPLE:
            return {"a": "\a", "f": "\f", "t": "\t", "n": "\n", "r": "\r", "v": "\v"}[char], SIMPLE[char]
        if char in CLASSES and char:
            return None, CLASSES[char]
        if not char or char.isalnum() or ord(char) > 127:
            raise self.fail(f"unknown escape \\{char}")
        return char, literal(char)

    def bracket(self) -> str:
        """A class in brackets."""
        self.at += 1
        made, first = ["[^" if self.text.startswith("^", self.at) else "["], True
        self.at += len(made[0]) - 1
        while first or not self.text.startswith("]", self.at):
            first = False
            if self.at >= len(self.text):
                raise self.fail("a class without an end")
            if self.text.startswith("[:", self.at) and (end := self.text.find(":]", self.at + 2)) >= 0:
                name = self.text[self.at + 2 : end]
                if (form := POSIX.get(name.removeprefix("^"))) is None:
                    raise self.fail(f"unknown class [:{name}:]")
                made.append(form.replace("\\p", "\\P").replace("\\w", "\\W") if name.startswith("^") else form)
                self.at = end + 2
                continue
            low, form = self.member()
            if self.text.startswith("-", self.at) and self.text[self.at + 1 : self.at + 2] not in ("", "]"):
                self.at += 1
                high, upper = self.member()
                if low is None or high is None or low > high:
                    raise self.fail("a bad range in a class")
                form = f"{form}-{upper}"
            made.append(form)
        self.at += 1
        return "".join(made) + "]"

    def member(self) -> tuple[str | None, str]:
        char = self.text[self.at]
        if char == "\\":
            return self.escape()
        self.at += 1
        return char, literal(char)

    def quoted(self) -> list[str]:
        """The characters between \\Q and \\E or the end."""
        end = self.text.find("\\E", self.at + 2)
        inside = self.text[self.at + 2 : end if end >= 0 else None]
        self.at = end + 2 if end >= 0 else len(self.text)
        return [literal(c) for c in inside]

    def repeat(self) -> str | None:
        """A repetition here, written as it is."""
        if self.text[self.at] in "*+?":
            form, self.at = self.text[self.at], self.at + 1
        elif found := self.take(COUNT):
            low, high = int(found[1]), int(found[3] or found[1])
            if low > high or high > MOST_REPEATS:
                raise self.fail("a bad number of repeats")
            form = found[0]
        else:
            return None
        if self.text.startswith("?", self.at):
            form, self.at = form + "?", self.at + 1
        return form

    def group(self) -> str:
        if found := self.take(NAMED):
            if found[1] in self.names:
                raise self.fail("a group's name twice")
            self.names.add(found[1])
            return "("
        if found := self.take(FLAGS):
            on, off, end = found[1], found[2] or "", found[3]
            if not on and not off and end == ")":
                raise self.fail("flags that are missing")
            on, off = (x.replace("U", "").replace("i", "iu") for x in (on, off))  # greed doesn't change whether a name matches
            return f"(?{on}{'-' + off if off else ''}{end}" if on or off or end == ":" else ""
        if self.text.startswith("(?", self.at):
            raise self.fail("a kind of group that RE2 lacks")
        self.at += 1
        return "("

    def run(self) -> str:
        self.names, depth, repeatable, repeated = set(), 0, False, False
        while self.at < len(self.text):
            char = self.text[self.at]
            if char in "*+?{" and (form := self.repeat()):
                if not repeatable or repeated:
                    raise self.fail("nothing to repeat")
                self.out.append(form)
                repeated = True
                continue
            repeatable, repeated = True, False
            if char == "(":
                opened = self.group()
                self.out.append(opened)
                depth += not opened.endswith(")") and opened != ""
                repeatable = False
            elif char == ")":
                depth -= 1
                if depth < 0:
                    raise self.fail("a bracket that nothing opened")
                self.out.append(")")
                self.at += 1
            elif char == "[":
                self.out.append(self.bracket())
            elif char in "|^$.":
                self.out.append(char)
                self.at += 1
                repeatable = char != "|"
            elif char != "\\":
                self.out.append(literal(char))
                self.at += 1
            elif (after := self.text[self.at + 1 : self.at + 2]) == "Q":
                self.out += self.quoted()
            elif after in ("b", "B"):
                self.out.append(BORDER[after])
                self.at += 2
            elif after in ("A", "z"):
                self.out.append(f"\\{after}")
                self.at += 2
            else:
                self.out.append(self.escape()[1])
        if depth:
            raise self.fail("a bracket without an end")
        return "".join(self.out)


def translated(text: str) -> str:
    """The RE2 pattern in the other syntax; a BadPattern if RE2 refuses it."""
    return Translation(text).run()
