"""The search over a whole document lets every line with evidence through."""

from rasterloom.llm import residue as R
from tests.llm.test_residue import CASES, OTHERS, UNSEEN

LONG = "http://a.example/" + "x" * 60
TEXTS = [
    "Error 404\nNothing here", "Error 404\r\nNothing here", f'The page you requested "{LONG}" could not be found', f"The page you requested `{LONG}` cannot be shown", f"Sample text „{LONG}“ please replace",
    f"Could not connect «{LONG}» database", "the <code>x</code> page you requested could not be found", 'The page you requested "a\nb" could not be found', "{{ `{}` }}", "a\n    {{ x }}\nFehler 500\nb", "Error   code :\t404", "The   page you\nasked",
]


def test_superset():
    r = R.reader()
    for t in [*TEXTS, *CASES, *OTHERS, *UNSEEN]:
        lines = R.masked_lines(t or "")
        assert r.evidence(lines) == [(i, k) for i, x in enumerate(lines) if (k := r.kind(x))], t
    assert all(r.evidence(R.masked_lines(t)) for t in TEXTS[:-2] if t != "{{ `{}` }}")
