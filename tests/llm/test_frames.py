"""Pages whose article lies in a form, a dialog, or a page that is hidden at first."""

import pytest

from quotelens.llm.html_extraction import main_text

PROSE = [f"The {w} part of the report says, at some length, what was found; it names places, dates, and people, and it ends with a question. Was it so?" for w in ("first", "second", "third", "fourth")]
BODY = "".join(f"<p>{p}</p>" for p in PROSE)
NAV = "<nav><a href=/>Home</a> <a href=/a>About</a></nav>"
FOOT = "<footer>Copyright, all rights reserved.</footer>"
LOGIN = "<form><label>Name</label><input><label>Password</label><button>Log in</button> Forgot it? Ask us, or sign up.</form>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id=aspnetForm>{NAV}<article>{BODY}</article>{FOOT}</form></body>",
        f"<body><form id=aspnetForm>{NAV}<div>{BODY}</div>{FOOT}</form></body>",
        f"<body><form>{NAV}<div class=content>{LOGIN}{BODY}</div>{FOOT}</form></body>",
        f"<body>{NAV}<div role=form><article>{BODY}</article></div>{FOOT}</body>",
        f"<body>{NAV}<div role=dialog><main>{BODY}</main></div>{FOOT}</body>",
        f"<body>{NAV}<div role=search><div>{BODY}</div></div>{FOOT}</body>",
        f"<body style='visibility:hidden'>{NAV}<article>{BODY}</article>{FOOT}</body>",
        f"<html hidden><body aria-hidden=true>{NAV}<article>{BODY}</article>{FOOT}</body></html>",
        f"<body>{NAV}<article>{BODY}</article>{LOGIN}{FOOT}</body>",
        f"<body>{NAV}<div>{BODY}{LOGIN}</div>{FOOT}</body>",
    ],
)
def test_the_article_and_no_more(page):
    assert main_text(page) == "\n\n".join(PROSE)


def test_formula_in_a_sentence():
    page = f"<body><article>{BODY}<p>The formula <math><mi>a</mi><mo>+</mo><mn>1</mn></math> is known, and it is used in all that follows here.</p></article></body>"
    assert main_text(page).endswith("The formula a+1 is known, and it is used in all that follows here.")
