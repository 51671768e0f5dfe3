"""Catalogues of the known sources, and the choice of some of them."""

from __future__ import annotations

from dataclasses import dataclass

from skein.operators.normalise import CONVERSATIONS


@dataclass(frozen=True)
class Source:
    key: str
    task: str = ""
    weight: float = 0.0  # share of the byte budget of a corpus
    column: str = "text"
    kind: str = "parquet"
    schema: str = ""  # of preference pairs
    include: str = ""
    exclude: str = ""
    keep_files: str = ""
    max_rows: int | None = None
    enabled: bool = True


# Corpora with their weights, textbooks with their kinds, row limits of the chat and pair sources.
CORPORA = (
    Source("fineweb-edu", weight=0.42),
    Source("cosmopedia", weight=0.38),
    Source("python-edu", weight=0.06, column="content"),
    Source("fineweb", weight=0.14),
)
TEXTBOOKS = (
    Source("openstax", kind="txt"),
    Source("ncert", kind="pdf", include=r"(English_Medium|Languages/English)", exclude=r"(Hindi_Medium|Hindi_[A-Za-z]+/)"),
    Source("libretexts-chem", column="html"),
)
_MAX_ROWS = {"soda": 60_000, "squad-v2": 80_000, "xsum": 40_000, "nl2sh": 25_000, "metamath": 90_000, "orca-math": 25_000}
CHATS = tuple(Source(key, task, max_rows=_MAX_ROWS.get(key), enabled=key != "soda") for key, (task, _) in CONVERSATIONS.items() if key != "samsum")
PAIRS = (
    Source("ultrafeedback", "helpful", schema="messages_pair", keep_files="prefs", max_rows=40_000),
    Source("hh-rlhf", "harmless", schema="hh_transcript", max_rows=30_000),
    Source("orca-dpo", "instruct", schema="system_input_pair"),
    Source("shp", "helpful", schema="shp", max_rows=20_000, enabled=False),
    Source("rm-static", "helpful", schema="hh_prompt_pair", max_rows=20_000, enabled=False),
)


def select(catalogue: tuple[Source, ...], only: list[str] = (), tasks: list[str] = (), everything: bool = False) -> list[Source]:
    """The sources asked for by key, in that order, else the enabled ones, or all of them; of the given tasks where any are.  An unknown key is an error."""
    by = {s.key: s for s in catalogue}
    if unknown := [k for k in only if k not in by]:
        raise KeyError(f"no such sources: {', '.join(unknown)}")
    some = [by[k] for k in only] if only else [s for s in catalogue if everything or s.enabled]
    return [s for s in some if not tasks or s.task in tasks]
