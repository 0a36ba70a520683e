import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcast.llm import secrets

from . import brute

HEX = "0123456789abcdef" * 2
HARD = [None, "", f"é password=abcdefgh1 AKIAABCDEFGHIJKL {HEX}", "token=secret=abcdefghij", "token: secret: longvalue123", "PASSWORD = 'short'", f"x{HEX}G{HEX[:31]}", "AKIAAKIAAKIAAKIA AKIAa", "apikey=12345678\napi_key=\n123456789", "ſecret=abcdefghijk", "to", "ken=abcdefghi"]


def base_of(batch):
    found, _ = secrets.scan_batch(pa.array(batch, pa.string()))
    return [[f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in x if k < 3] for x in found]


def lexed(text):
    found, _ = secrets.scan_batch(pa.array([text]))
    return [text[s:e] for s, k, e in found[0] if k == 3]


def test_base_spans():
    assert base_of(HARD) == [brute.secrets_base(x) for x in HARD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["password", "Token", "secret", "api_key", " ", "=", ":", "'", '"', "abcd1234", HEX, "AKIA", "ABCDEFGHIJKLMNOP", "é", "\n", "z", "-"]), max_size=14).map("".join), max_size=4))
def test_base_spans_of_any_text(batch):
    assert base_of(batch) == [brute.secrets_base(x) for x in batch]


def test_assignments():
    assert lexed("db_password = 'hunter2-Xk9qLm3'") == ["hunter2-Xk9qLm3"]
    assert lexed('{"client": {"privateKey": "MIIEvQIBADANBg"}}') == ["MIIEvQIBADANBg"]
    assert lexed("export AWS_ACCESS_KEY: s8Kd92jfLq0x") == ["s8Kd92jfLq0x"]
    assert lexed("config['api_key'] = \"a8f5f167f44f4964\"") == ["a8f5f167f44f4964"]
    assert lexed("password: str = 'Zx81kQwP0rt'") == ["Zx81kQwP0rt"]


def test_constants_propagate():
    text = "DEFAULT = 'k3JdP9wQ2x71'\nfallback = DEFAULT\npassword = fallback\ncolour = 'k3JdP9wQ2x72'"
    assert lexed(text) == ["k3JdP9wQ2x71"]
    assert lexed("a = b\nb = a\nsecret = a\na = 'k3JdP9wQ2x71'") == ["k3JdP9wQ2x71"]


def test_harmless():
    for text in ("password_length = 'abcdefgh1234'", "password = 'changeme-please'", "token = '${TOKEN_FROM_ENV}'", "title = 'k3JdP9wQ2x71'", "secret == 'k3JdP9wQ2x71'", "password = 'aaaaaaaaaaaaaaaa'", "the token: of the year"):
        assert lexed(text) == [], text


def test_query(spark):
    docs = spark.createDataFrame([(None, "password=abcdefgh1", 7), (1, None, 8), (1, "x", 9)], "doc_id long, text string, spans int")
    got = sorted(secrets.scan(docs).collect(), key=lambda r: (r.doc_id is None, r.spans))
    assert [(r.doc_id, r.n_assign, r.base_sha256) for r in got] == [(1, 0, brute.sha("")), (1, 0, brute.sha("")), (None, 1, brute.sha("assign:0:18"))]
    assert got[2].spans == "assign:0:18,lexed:9:18"
    assert secrets.scan(docs.limit(0)).collect() == []


K = "k3JdP9wQ2x71"


def found(text, *want):
    assert lexed(text) == list(want), text


def test_calls_and_markup():
    found(f'client.setPassword("{K}");', K)
    found(f'builder.password("{K}").build()', K)
    found(f'props.put("db.password", "{K}")', K)
    found(f"os.getenv('API_KEY', '{K}')", K)
    found(f"<pwd>{K}</pwd><user>x</user>", K)
    found(f'<add key="ApiKey" value="{K}"/>', K)
    found(f'<property name="db.password">{K}</property>', K)
    found(f"<conf>\n  <db:password>\n    {K}\n  </db:password>\n</conf>", K)
    found(f"deploy --api-key {K} --verbose", K)
    found(f"Authorization: Bearer {K}", K)
    found(f'connect(host="h", password="{K}")', K)
    found(f'load_password("{K}.txt")')


def test_values_over_lines():
    found(f"password:\n  {K}\nuser: x", K)
    found(f"secret: |\n  {K}\nuser: x", K)
    found("password:\n  length: 12\n  hint: 'abcdefgh1234'")
    found(f'password = """{K}"""', K)
    found(f"token = (\n    '{K}'\n)", K)
    found(f'token = \\\n  "{K}"', K)
    found('password = "k3JdP9" + "wQ2x71"', 'k3JdP9" + "wQ2x71')
    found('password = "k3JdP9" +\n  "wQ2x71"', 'k3JdP9" +\n  "wQ2x71')
    found('password = ("k3JdP9" "wQ2x71")', 'k3JdP9" "wQ2x71')
    found(f'title = "x"\n"{K}"')
    found(f'password = "a\\"{K}"', f'a\\"{K}')


def test_expressions_are_no_literals():
    for text in ("pwd = os.environ['DB_PWD_2024']", "pwd = load_password(path)", "password = settings.database.password", "token = request.headers2.token", "secret = user_input", "password = $DB_PASSWORD1", "if password == 'k3JdP9wQ2x71':", "password != 'k3JdP9wQ2x71'"):
        found(text)
    for word in ("true", "null", "none", "false", "undefined"):
        found(f"password = {word}")
        found(f"password = 'Zk39fjq0{word}'", f"Zk39fjq0{word}")


def test_order_of_assignments():
    found(f"x = '{K}'\nx = 'other-0Vb7Yt'\npassword = x", "other-0Vb7Yt")
    found(f"x = '{K}'\npassword = x\nx = 'other-0Vb7Yt'", K)
    found(f"x = '{K}'\nx = load()\npassword = x")
    found(f"password = x\nx = '{K}'\nx = 'other-0Vb7Yt'", K)
    found(f"a = secret = '{K}'", K)
    found(f"y = 'first-0Vb7Yt'\npassword = y = '{K}'", K)
    found(f"var token string = '{K}'", K)
    found(f"Map<String, String> auth_token = '{K}'", K)
    found("api_token += 'k3JdP9wQ2x71'\napi_token += 'other-0Vb7Yt'", K, "other-0Vb7Yt")


def program(r):
    """Lines of assignments, and the literals that a run of them by hand gives a sensitive name."""
    names = ["alpha", "beta", "gamma", "db_password", "apiToken", "note"]
    lines, value, secret, every = [], {}, set(), []
    for _ in range(r.randrange(1, 15)):
        name, kind = r.choice(names), r.randrange(7)
        literal = "".join(r.sample("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ", 11)) + str(r.randrange(100, 999))
        if kind < 3:
            quote = r.choice(['"', "'", '"""'])
            lines.append(r.choice([f"{name} = {quote}{literal}{quote}", f"{name}: str = {quote}{literal}{quote};", f"self['{name}'] = {quote}{literal}{quote}  # {r.choice(names)}", f"set_{name}({quote}{literal}{quote})"]))
            value[name] = literal
            every.append(literal)
        elif kind < 5:
            other = r.choice([x for x in names if x in value] or [None])
            if other is None:
                continue
            lines.append(f"{name} = {other}")
            value[name] = value[other]
        elif kind == 5:
            lines.append(f"{name} = compute({r.choice(names)})")
            value.pop(name, None)
        else:
            lines.append(r.choice(["# a remark", "", "if alpha == beta:", "run(1, 2)", "it's said"]))
            continue
        if name in ("db_password", "apiToken") and name in value:
            secret.add(value[name])
    return "\n".join(lines), [x for x in every if x in secret]


def test_programs_run_by_hand():
    import random

    for seed in range(1500):
        text, want = program(random.Random(seed))
        assert lexed(text) == want, (seed, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "key", "api", " ", "=", ":", "'", '"', "\n", "(", ")", "[", "]", "<", ">", "/", "+", ",", "--", K, "é", "\\", "|", "`", "$", "{"]), max_size=40).map("".join))
def test_any_text_is_read(text):
    spans, scores = secrets.scan_batch(pa.array([text, f"x = '{K}'"]))
    assert len(spans) == 2 and all(0 <= s <= e <= len(text) for s, _, e in spans[0]) and spans[1] == []


def test_long_texts():
    import time

    for text in ("word " * 200_000 + f"password = '{K}'", "password = 'a' + " * 20_000 + "1", "<key " * 40_000, "a = " * 40_000 + f"password = '{K}'", "key: '" * 40_000, "(" * 100_000 + "password", "password:\n " * 30_000, "x1 = y1\n" * 30_000 + "password = x1", "".join(f"n{i} = n{i + 1}\n" for i in range(20_000)) + f"n20000 = '{K}'\npassword = n0", "key\\" * 50_000, '"""key' * 30_000):
        began = time.perf_counter()
        secrets.scan_batch(pa.array([text]))
        assert time.perf_counter() - began < 10, text[:40]
