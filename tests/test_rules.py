import pytest

from attestor.operators import rules

LIST = ["// ===BEGIN ICANN DOMAINS===", "com", "uk", "co.uk  trailing words", "", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "// ===END ICANN DOMAINS===", "// ===BEGIN PRIVATE DOMAINS===", "github.io", "io", "blogspot.com", "// ===END PRIVATE DOMAINS==="]
HOSTS = ["com", "example.com", "a.b.example.com", "uk", "co.uk", "x.co.uk", "a.x.co.uk", "ck", "www.ck", "a.www.ck", "b.ck", "a.b.ck", "c.a.b.ck", "kawasaki.jp", "city.kawasaki.jp", "x.city.kawasaki.jp", "q.kawasaki.jp", "p.q.kawasaki.jp",
         "me.github.io", "github.io", "a.me.github.io", "blogspot.com", "z.blogspot.com", "localhost", "nowhere.zz", "", None]


def plain_registrable(host, lines):
    """The list's own algorithm over one host."""
    labels = host.split(".")
    found = []
    for line in lines:
        rule = line.split()[0] if line.split() else ""
        if not rule or rule.startswith("//"):
            continue
        own = rule.lstrip("!").split(".")
        if len(own) <= len(labels) and all(r in ("*", x) for r, x in zip(own[::-1], labels[::-1])):
            found.append((rule.startswith("!"), len(own)))
    if not found:
        return None
    exception, n = max(found)
    n -= exception
    return None if len(labels) <= n else (".".join(labels[-n:]), labels[-n - 1], ".".join(labels[-n - 1 :]))


@pytest.mark.parametrize("most", [200_000, 0])
def test_registrable(spark, tmp_path, monkeypatch, most):
    """Against the algorithm host by host; rules broadcast and salted."""
    monkeypatch.setattr(rules, "BROADCAST_RULES", most)
    (tmp_path / "list.dat").write_text("\n".join(LIST))
    df = spark.createDataFrame([(h, "x") for h in HOSTS * 2], "host string, Suffix string")
    for private, lines in ((True, LIST), (False, LIST[: LIST.index("// ===BEGIN PRIVATE DOMAINS===")])):
        got = {r.host: (r.suffix, r.label, r.registrable) for r in rules.registrable(df, rules.read_suffix_rules(spark, f"file://{tmp_path}/list.dat", private)).collect()}
        assert got == {h: x for h in HOSTS if h and (x := plain_registrable(h, lines))}
    assert rules.registrable(df.limit(0), rules.read_suffix_rules(spark, f"file://{tmp_path}/list.dat")).count() == 0
    assert rules.registrable(df, rules.suffix_rules(spark.createDataFrame([], "value string"))).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_longest_prefix_and_suffix(spark, monkeypatch, most):
    monkeypatch.setattr(rules, "BROADCAST_RULES", most)
    table = [("a", "m", 1.0), ("a", "m-1", 2.0), ("a", "m-1-mini", 3.0), ("b", "*", 0.0), ("b", "m-1", 4.0), ("a", "m-1", 1.5), ("a", None, 9.0)]
    names = [("a", "m-1-mini-2024"), ("a", "m-1"), ("a", "m-12"), ("a", "x"), ("a", ""), ("b", "x"), ("b", "m-1z"), ("c", "m"), ("a", None), ("a", "*")] * 2
    got = {(r.p, r.name): (r.rule, r.price) for r in rules.longest_prefix(spark.createDataFrame(names, "p string, name string"), spark.createDataFrame(table, "p string, prefix string, price double"), ["p"], "name").collect()}
    assert got == {("a", "m-1-mini-2024"): ("m-1-mini", 3.0), ("a", "m-1"): ("m-1", 1.5), ("a", "m-12"): ("m-1", 1.5), ("b", "x"): ("*", 0.0), ("b", "m-1z"): ("m-1", 4.0)}
    kinds = spark.createDataFrame([("d.org", "x"), ("a.d.org", "y"), ("a.d.org", "z")], "rule string, kind string")
    hosts = spark.createDataFrame([("d.org",), ("q.a.d.org",), ("a.d.org",), ("bd.org",), ("org",), (None,)], "host string")
    assert {r.host: (r.suffix, r.kind) for r in rules.longest_suffix(hosts, kinds, take=("kind",)).collect()} == {"d.org": ("d.org", "x"), "q.a.d.org": ("a.d.org", "y"), "a.d.org": ("a.d.org", "y")}
