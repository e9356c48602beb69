"""Known publishers: how their pages are told, which characters they write oddly, and how often they may be asked."""

from __future__ import annotations

from dataclasses import dataclass, field

# What stands on a publisher's pages. The first publisher, in the order of names, with a pattern that is found is a page's.
IDENTIFIERS: dict[str, list[str]] = {
    "AmPsych": ['<meta name="dc.Publisher" content=" American Psychiatric Publishing'],
    "Frontiers": ['<article-id pub-id-type="doi">10.3389'],
    "HighWire": ["highwire-journal", "http://schema.highwire.org/Linking", "highwire-journal-article"],
    "JournalOfCognitiveNeuroscience": ['property="og:site_name" content="MIT Press"', "<title>MIT Press Journals - Journal of Cognitive Neuroscience - Full Text</title>"],
    "MDPI": [r'meta\s*name="citation_publisher"\s*content="Multidisciplinary Digital Publishing Institute"', r"www\.mdpi\.com"],
    "NationalAcademyOfSciences": ['<meta name="citation_journal_title" content="Proceedings of the National Academy of Sciences">'],
    "OUP": ["OUP Academic"],
    "OldSpringer": ["- Springer</title>"],
    "PMC": ['<meta name="ncbi_db" content="pmc" />', '<meta name="ncbi_db" content="pmc">'],
    "Plos": ["<publisher-name>Public Library of Science</publisher-name>"],
    "Sage": [r"journals\.sagepub\.com", r'meta\s*name="dc.Publisher"\s*content="SAGE Publications', 'class="header__logo".*sagepub'],
    "ScienceDirect": ["title=\"ScienceDirect -The world's leading full-text scientific database\"", "- ScienceDirect</title>"],
    "Springer": [
        '<meta content="Springer" name="dc.publisher"/>', '<meta property="og:site_name" content="SpringerLink"', '<meta property="og:site_name" content="Nature"/>', '<meta content="Nature Publishing Group" name="dc.publisher">',
        '<meta name="citation_publisher" content="Nature Publishing Group">', '<meta name="dc.publisher" content="Nature Publishing Group">', '<meta content="BioMed Central" name="dc.publisher"/>', '<meta property="og:site_name" content="BioMed Central">',
    ],
    "TaylorAndFrancis": [r"tandfonline\.com", r'<meta\s+name="dc\.Publisher"\s+content="Taylor\s*&\s*Francis\s*Group"', r'<meta\s+property="og:site_name"\s+content="Taylor\s*&\s*Francis"', r"tandf\.tfviewerdata"],
    "Wiley": ["Wiley Online Library</title>"],
}

# Odd characters of all publishers with what they stand for, named entities first.
ENTITIES = {
    "&nbsp;": " ", "&minus;": "-", "\xa0": " ", "−": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "舑": "-",
    "Ő": "-", "ŷ": "", "Š": "", "Ņ": "'", "ņ": "'", " ": "", " ": "",
}
OWN_ENTITIES = {
    "Frontiers": {"&#x02212;": "-", "&#x02009;": " "},
    "JournalOfCognitiveNeuroscience": {" ": " "},
    "TaylorAndFrancis": {"&thinsp;": ""},
}
DELAYS = {"HighWire": 10, "JournalOfCognitiveNeuroscience": 10, "NationalAcademyOfSciences": 5, "OUP": 10, "Sage": 1, "TaylorAndFrancis": 2}


@dataclass(frozen=True)
class Publisher:
    name: str
    identifiers: tuple[str, ...]
    entities: dict[str, str] = field(default_factory=dict)
    delay: int = 0


def publishers() -> list[Publisher]:
    """All publishers in the order in which pages are matched."""
    return [Publisher(n, tuple(IDENTIFIERS[n]), {**OWN_ENTITIES.get(n, {}), **ENTITIES}, DELAYS.get(n, 0)) for n in sorted(IDENTIFIERS)]


def from_json(text: str, stem: str) -> Publisher:
    """A publisher from a JSON config (name, identifiers, entities, delay); the file's stem is its key."""
    import json

    d = json.loads(text)
    return Publisher(stem, tuple(d.get("identifiers") or ()), {**(d.get("entities") or {}), **ENTITIES}, int(d.get("delay") or 0))
