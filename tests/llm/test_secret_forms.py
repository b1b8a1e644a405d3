"""Forms of assignment, against spans given by hand."""

from __future__ import annotations

import time

import pytest

from lodestone.llm import secrets

V = "Xk9!vQ2#mLp7"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f'config: db_password="{V}"', [V]),
        (f'db_password: str = "{V}"', [V]),
        (f'db_password: Optional[str] = "{V}"', [V]),
        (f'const apiToken: string = "{V}";', [V]),
        (f'password = f"{V}"', [V]),
        (f'password = rb"{V}"', [V]),
        (f'x = password = "{V}"', [V]),
        (f'password = x = "{V}"', [V]),
        (f'url: password: "{V}"', [V]),
        (f'config["db_password"] = "{V}"', [V]),
        (f"os.environ['db_password'] = '{V}'", [V]),
        (f'A = "{V}"\nB = "q9W8e7R6t5Y4"\npassword = A + B', [V, "q9W8e7R6t5Y4"]),
        (f'A = "{V}"\nB = "q9W8e7R6t5Y4"\npassword = A+B', [V, "q9W8e7R6t5Y4"]),
        (f'password = "{V}" + "q9W8e7R6t5Y4"', [V, "q9W8e7R6t5Y4"]),
        (f'password = later\nlater = "{V}"', [V]),
        (f'password = """{V}"""', [V]),
        (f'a = b\nb = a\npassword = a\nk = "{V}"', []),
        (f'password:\n  title: "{V}"', []),
        ("passphrase=Zx81kQ9pLm22==", ["Zx81kQ9pLm22=="]),
        ("passphrase: Zx81:kQ9pLm22", ["Zx81:kQ9pLm22"]),
        ("db_password = https://h/x9?k=Zx81kQ9p", ["https://h/x9?k=Zx81kQ9p"]),
    ],
)
def test_forms_of_assignment(text, want):
    found = secrets.assigned_literals(text, secrets.SecretRules())
    assert [text[a:b] for a, b, _ in found] == want


def test_long_texts_take_linear_time():
    for piece in ("a: ", "a=", "a + ", 'x = "', "token: b[", "password = a + ", "-a", "'''", 'k = r"""'):
        began = time.process_time()
        secrets.assigned_literals(piece * 20_000, secrets.SecretRules())
        assert time.process_time() - began < 5, piece


@pytest.mark.parametrize("piece", ["a=", "token=a+"])
def test_chains_without_spaces_take_linear_time(piece):
    began = time.process_time()
    secrets.assigned_literals(piece * 40_000, secrets.SecretRules())
    assert time.process_time() - began < 5
