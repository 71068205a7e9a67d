"""The generated battery: every mark against every run of spaces against every neighbour."""

from itertools import product

#: The marks, spaces, neighbours and words that the digests below follow from.
SPACE, NBSP, NNBSP, THIN, RSQ, LSQ = " ", "\u00a0", "\u202f", "\u2009", "’", "‘"
MARKS = ("«", "»", "„", "“", "”", LSQ, RSQ, '"', "'")
OUTER = ("", SPACE, "x", "1", ".", "\n")
SPACES = ("", SPACE, NBSP, NNBSP, THIN, SPACE + SPACE, SPACE + NBSP, NBSP + NBSP, THIN + SPACE)

#: The first 12 hex digits of the SHA-256 of what each style does to the battery.
DIGESTS = {
    "de-CH": "ce18734a695d",
    "de-DE": "62c2c138ebc4",
    "en": "328d500db6b4",
    "es": "c490cf732002",
    "fr": "f0369d6a78d0",
    "nl": "2507ee04f1f0",
    "fr+00A0": "c4eebc40f8e2",
    "fr+202F": "804a0b17d89b",
}


def battery() -> list[str]:
    quoted = [
        f"{o}{a}{inner}{b}{o}"
        for a, s, b, o in product(MARKS, SPACES, MARKS, OUTER)
        for inner in (f"{s}woord{s}", s)
    ]
    stops = [f"mot{s}{m} suite" for s in SPACES for m in ";:!?"]
    opened = [f"¿{s}que? ¡{s}vaya!" for s in SPACES]
    said = ["Er sagte »Wort« und ging.", "Il dit « mot » puis.", f"auto{RSQ}s en {LSQ}s morgens", "auto's en 's morgens"]
    return [*quoted, *stops, *opened, *said, f"aaa{SPACE * 40}«", f"«{SPACE * 40}"]
