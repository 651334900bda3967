r"""Text cleaning: an ordered chain of replacements, then trimming, then dropping of empty rows.

The chain is kept as it acts, with steps that are dead or lossy: ``quot;?`` rewrites ordinary words,
acronyms in brackets go, 'RESULTING' loses its head. Classes are Unicode-aware, ``(?U)``; ``^`` is the
start of the text only. ``strict_words`` leaves those two damaging steps out.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(names: str, sep: str = ",") -> str:
    return "(?:" + "|".join(sorted(x.strip().replace(".", r"\.") for x in names.split(sep))) + ")"


_CAPITALS = "BERLIN, TOKYO, MOSCOW, BEIJING, PARIS, LONDON, NEW YORK, WASHINGTON"
_CITIES = _any(
    _CAPITALS + ", ATLANTA, BOSTON, BRUSSELS, CHICAGO, DALLAS, DENVER, DETROIT, GENEVA, HOUSTON, LOS ANGELES, MADRID, MEXICO CITY, MIAMI, "
    "PHILADELPHIA, PHOENIX, ROME, SAN DIEGO, SANFRANCISCO, SEATTLE, SEOUL, SYDNEY"
)
_FIRST_CITIES = _any(_CAPITALS)
_STATES = _any(
    "Wyo.;Wis.;W.Va.;Wash.;Va.;Vt.;Tex.;Tenn.;S.D.;S.C.;R.I.;Pa.;Ore.;Okla.;Ohio;N.D.;N.C.;N.Y.;Nev.;Neb.;Mont.;Mo.;Miss.;Minn.;Mich.;"
    "Mass.;Md.;La.;Ky.;Kan.;Ind.;Ill.;Ga.;Fla.;Del.;Conn.;Colo.;Calif.;Ark.;Ariz.;Ala.",
    ";",
)
_ZONES = _any(", ".join(a + b + "T" for a in "ECMP" for b in "SD") + ", GMT, UTC")
_HEADS = r"(?:INTRODUCTION|ABSTRACT|DISCUSSION|OBJECTIVE|BACKGROUND|CONCLUSIONS?|METHODS?|RESULTS?)"
_COLON_HEADS = _any("SUMMARY, ABSTRACT, DISCUSSION, INTRODUCTION, CONCLUSIONS, CONCLUSION, RESULTS, METHODS, OBJECTIVE, BACKGROUND")
_WIKI = _any("External links, References, Awards, Education, Legacy, Death, Personal life, Career, Background, Early life, Biography, History")
_THIS = "This " + _any("research, abstract, article, study, paper") + r"\s+"
_WIRES, _MORE_WIRES = _any("UPI, Reuters, AFP, AP"), _any("Bloomberg, UPI, Reuters, AFP, AP")
_DASH = [(r"\s*—\s*(?:A|The)\s+", " "), (r"\)\s*—\s*", ") ")]


def _at_start(pattern: str) -> list[tuple[str, str]]:
    """At the start of the text, and at the start of a line."""
    return [("^" + pattern, ""), (r"\n" + pattern, "\n")]


LOSSY = {r"quot;?", rf"\b{_HEADS}[\s:]*"}
#: Pattern and replacement, in order.
STEPS: list[tuple[str, str]] = [
    *(("â€" + tail, to) for tail, to in (("™", "'"), ("œ", '"'), ("", '"'), ('"', "—"), ('"', "–"))),
    *((f"&{name};", to) for name, to in (("#39", "'"), ("quot", '"'), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("nbsp", " "), (r"#(\d+)", ""))),
    (r"#39;?", "'"),
    (r"quot;?", '"'),
    (r"<br\s*/?>", " "),
    (r"</?" + _any("ul, ol, li, i, b, em, strong, span, div, p")[:-1] + r"|h[1-6])>", ""),
    (r"\[\d+\][.,;:)\]]?", ""),
    (r"\b\d+\][.,;]?", ""),
    (r"\[\d+\]\.\s*\n", "\n"),
    *((p, "") for p in (r"\[\d+", r"\d+\]", r"\[\d+\]")),
    (r"\s*\([A-Z]{2,}\)\s*", " "),
    (rf"\b{_WIRES}\s*[-—]\s*", ""),
    *_at_start(_FIRST_CITIES + r"[,—]\s*"),
    *_DASH,
    (rf"\s*\({_MORE_WIRES}\)\s*", " "),
    (rf"\b{_MORE_WIRES}\s*[-—]\s*", ""),
    (rf",\s*{_STATES}\b", ","),
    *_at_start(_CITIES + r"\s*[,—]\s*"),
    *_DASH,
    (rf"\b{_HEADS}[\s:]*", ""),
    (rf"(?:^|\n)\s*{_COLON_HEADS}:\s*", "\n"),
    *(x for heads in (_WIKI, "Description") for x in ((rf"\.\s*{heads}\s*\n", ".\n"), (rf"^\s*{heads}\s*\n", ""))),
    (rf"\s+{_ZONES}[,.]?\s+", " "),
    (rf"\s+at\s+\d{{1,2}}:\d{{2}}\s*(?:[AP]M|[ap]m)?\s*{_ZONES}?\s*[,.]?", " "),
    *_at_start(_THIS),
    *_at_start(r"\d+\.\s+"),
    ("  +", " "),
    ("\n\n\n+", "\n\n"),
    (" \n", "\n"),
    ("\n ", "\n"),
]


#: By a piece of a pattern, strings of which one must be in a text for the pattern to match.
_NEEDS: list[tuple[str, tuple[str, ...]]] = [
    (_COLON_HEADS, (":",)), ("â€", ("â€",)), ("#39;?", ("#39",)), ("quot;?", ("quot",)), ("&", ("&",)), ("<", ("<",)), (r"\n\s*", ("\n",)),
    (r"\([A-Z]{2,}\)", ("(",)), (rf"\({_MORE_WIRES}\)", ("(",)), (rf"\b{_WIRES}", ("UPI", "Reuters", "AFP", "AP")), (rf"\b{_MORE_WIRES}", ("Bloomberg", "UPI", "Reuters", "AFP", "AP")),
    ("\n", ("\n",)), (r"\n", ("\n",)), (r"\[\d+", ("[",)), (r"\d+\]", ("]",)), ("—", ("—",)), (_STATES, (",",)), (r"\b(?:INTRODUCTION", ("INTRODUCTION", "ABSTRACT", "DISCUSSION", "OBJECTIVE", "BACKGROUND", "CONCLUSION", "METHOD", "RESULT")),
    (_WIKI, ("\n",)), ("Description", ("\n",)), (r"\s+at\s+", (":",)), (_ZONES, ("ST", "DT", "GMT", "UTC")), ("This ", ("This ",)), ("  +", ("  ",)), (" \n", (" \n",)),
]


def _needs(pattern: str) -> tuple[str, ...]:
    """Patterns for the start of a text are quick by themselves."""
    return () if pattern[0] == "^" else next((strings for piece, strings in _NEEDS if piece in pattern), ())


def _replaced(c: Column, strings: tuple[str, ...], steps: list[tuple[str, str]]) -> Column:
    """``steps`` one after the other, where one of ``strings`` is in the text; a variable, so that it is worked out once."""

    def run(x: Column) -> Column:
        return reduce(lambda y, step: F.regexp_replace(y, "(?U)" + step[0], step[1]), steps, x)

    if not strings:
        return run(c)
    there = lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(s)) for s in strings))
    return F.transform(F.array(c), lambda x: F.when(there(x), run(x)).otherwise(x))[0]


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def clean(c: Column, strict_words: bool = False) -> Column:
    """The chain, then white space, quotes and white space again off both ends. Steps that a text lacks a string for are passed over."""
    steps = [(p, r) for p, r in STEPS if not (strict_words and p in LOSSY)]
    for strings, some in groupby(steps, lambda step: _needs(step[0])):
        c = _replaced(c, strings, list(some))
    return strip(F.btrim(strip(c), F.lit("'\"")))


def clean_rows(df: DataFrame, column: str = "text", strict_words: bool = False) -> DataFrame:
    """Rows whose cleaned ``column`` is neither null nor empty."""
    return df.withColumn(column, clean(F.col(column), strict_words)).filter(F.char_length(column) > 0)
