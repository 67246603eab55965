"""Source syntax that gives name-literal pairs."""

import time

import pytest

from engram.llm import secrets

S = "x9Kq2mZp7LwT4"
SYNTAX = [
    'config["db_password"] = "{}"', "os.environ['SECRET_KEY'] = '{}'", 'c["db"][ "password" ] = "{}"', 'char db_password[] = "{}";',
    'db_password: str = "{}"', 'const dbPassword: string = "{}"', 'db_password: Optional[dict[str, str]] = "{}"', "x.db_password: str | None = '{}'", 'let db_password: &\'static str = "{}";', 'var dbPassword string = "{}"',
    'db_password = f"{}"', "db_password = b'{}'", 'db_password = rb"{}"', 'db_password: bytes = b"{}"',
    'db_password = """{}"""', "db_password = '''\n{}\n'''", 'db_password = f"""{}"""',
    'db_password =\n    "{}"', '"db_password":\n  "{}"', 'db_password = (\n    "{}"\n)', "db_password = \\\n  '{}'", 'db_password = ["{}"]', 'db_password: str = (\n  "{}"\n)', "db_password:\n  {}\n", "db_password: |\n  {}\n", "db_password:\r\n  {}\r\nx: 1",
    'db_password = "{}"', "db_password: {}", '{{"a": {{"db_password": "{}"}}}}', 'x = {{\n "db_password": "{}"}}', 'db_password ::= 1; token => "{}"',
]


@pytest.mark.parametrize("form", SYNTAX)
def test_found(form):
    text = form.replace("{}", S).replace("{{", "{").replace("}}", "}")
    assert [text[a:b] for a, b, k in secrets.scan(text) if k == "named"] == [S]
    assert S not in secrets.redact(text, secrets.scan(text))


def test_every_literal_of_a_list():
    text = 'token = [\n "x9Kq2mZp7LwT4",\n "y8Jr3nAq6MvU5"]\nother = "z7Hs4pBr5NwV6"'
    assert [text[a:b] for a, b, _ in secrets.named_spans(text)] == ["x9Kq2mZp7LwT4", "y8Jr3nAq6MvU5"]


def test_keys_and_fields_are_no_values():
    for text in ('secrets = {"database_user1": 1}', 'password = f"{config.password_1}"', "token:\n  refresh_after_9: 1", 'db_password: SecretStr = ""', "password == 'x9Kq2mZp7LwT4'"):
        assert secrets.named_spans(text) == [], text


def test_linear():
    for unit in ('a: b[', 'a: b<c<', 'x = """', "x = '''\\'", "a:\n ", 'k = (\n', 'k = ["a",', "a: b | c ", "a[b]['c'] ", 'a: f"', 'a = "\\'):
        start = time.process_time()
        secrets.scan(unit * 20_000)
        assert time.process_time() - start < 5, unit


def test_joined_literals_calls_and_elements():
    forms = {
        'db_password = "x9Kq2" + "mZp7LwT4"': ["x9Kq2", "mZp7LwT4"],
        'db_password = "x9Kq2" \\\n  "mZp7LwT4"': ["x9Kq2", "mZp7LwT4"],
        "$db_password = 'x9Kq2' . 'mZp7LwT4';": ["x9Kq2", "mZp7LwT4"],
        'String dbPassword = "x9Kq2"\n    + "mZp7LwT4";': ["x9Kq2", "mZp7LwT4"],
        f'props.setProperty("db.password", "{S}");': [S],
        f"define('DB_PASSWORD', '{S}');": [S],
        f'os.environ.setdefault("SECRET_KEY", "{S}")': [S],
        f"<config><db_password>{S}</db_password><user>x9Kq2mZp7LwT5</user></config>": [S],
        'print("name", "x9Kq2mZp7LwT4")': [],
        "<p>password</p> and (\"a\", 'b')": [],
    }
    for text, want in forms.items():
        assert [text[a:b] for a, b, _ in secrets.named_spans(text)] == want, text


def test_new_forms_are_linear():
    for unit in ('("a", ', '("', "<a>", "<a b>", '"a" + ', 'k = "a" + ', "</a>", "<a>bbbbbbbbb", '("a", "b"'):
        start = time.process_time()
        secrets.scan("x = 1 " + unit * 20_000)
        assert time.process_time() - start < 5, unit


def test_query_against_plain_patterns(spark):
    """Base spans, counts and digest of whole tables by plain patterns, and all spans by one scan of each text."""
    import hashlib
    import re

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (9_000_001, ""), (9_000_002, f'password="{S}" ' * 3000), (9_000_003, f"token={S}"), (9_000_003, f"token={S}")], "doc_id long, text string")
    texts = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.unionByName(odd).collect())
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.secret_digest(df.unionByName(odd)).collect())
    want = []
    for doc_id, text in texts:
        base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(base))
        n = [sum(k == x for _, k, _ in base) for x in range(3)]
        want.append((doc_id, *n, hashlib.sha256(shown.encode()).hexdigest(), secrets.shown(secrets.scan(text))))
    assert got == sorted(want)
