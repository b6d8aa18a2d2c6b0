"""The forest on findings that other rules made than those that it learnt from: whole texts of configuration, logs and prose."""

import base64
import hashlib
import json
import random
import string
import uuid

from gleaner.llm import secrets

SYLLABLES = "ba ke lo mi ru ta ve zo shi den gra pol ster wick mar fen".split()


def findings(n, seed=41):
    """Texts and whether each holds a secret; nothing here is shared with labelled_findings()."""
    rng = random.Random(seed)
    draw = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    alnum = string.ascii_letters + string.digits
    name = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(2, 4)))
    part = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    password = lambda: rng.choice([name().title() + rng.choice("#%&*") + str(rng.randint(10, 9999)), draw(alnum + "!#%^&*", rng.randint(10, 18)), name() + "-" + name() + str(rng.randint(1, 99))])
    secret = [
        lambda: f"{name().upper()}_SECRET={draw(alnum, 40)}\nDEBUG=0\n",
        lambda: f"db:\n  user: {name()}\n  password: {password()}\n  port: 5432\n",
        lambda: json.dumps({"host": name(), "apiKey": draw(alnum, 32)}),
        lambda: f"curl -H 'Authorization: Bearer {part({'alg': 'RS256'})}.{part({'sub': name(), 'n': rng.random()})}.{draw(alnum + '-_', 43)}' https://{name()}.io/v1",
        lambda: f"DATABASE_URL={rng.choice(['postgres', 'mysql', 'amqps', 'redis', 'mssql+pyodbc'])}://{name()}:{password()}@{name()}.internal:5432/{name()}",
        lambda: f"git clone https://{name()}:{draw(alnum, 22)}@git.{name()}.org/{name()}.git",
        lambda: f"const client = new Client({{ accessKey: '{draw(string.ascii_uppercase + string.digits, 20)}', region: 'north' }});",
        lambda: f"my key is ghp_{draw(alnum, 36)}, please don't share it",
        lambda: f"[default]\naws_access_key_id = AKIA{draw(string.ascii_uppercase + '234567', 16)}\noutput = json\n",
        lambda: f"os.environ['TOKEN'] = \"{rng.randbytes(24).hex()}\"",
    ]
    plain = [
        lambda: f"{rng.randbytes(20).hex()} refs/heads/{name()}",
        lambda: f"commit {rng.randbytes(20).hex()}\nAuthor: {name()}\n",
        lambda: f"request {uuid.UUID(int=rng.getrandbits(128))} took {rng.randint(1, 900)} ms",
        lambda: f"see https://www.{name()}.com/{name()}/{rng.randint(2000, 2024)}/{name()}-{name()}-{rng.randint(100000, 999999)}",
        lambda: f"open /var/{name()}/{name()}_{rng.randint(1000, 9999)}/{name()}.{rng.randint(1, 99)}.log",
        lambda: f"sha256:{hashlib.sha256(name().encode()).hexdigest()}  {name()}.tar.gz",
        lambda: f"called {name()}_{name()}_handler_{rng.randint(10, 99)} twice",
        lambda: "password: please choose one of at least twelve characters",
        lambda: f"url = mysql://{name()}:<password>@localhost/{name()}",
        lambda: f"export API_KEY=<your key>  # ask {name()}",
        lambda: f"card 4{rng.randint(10**14, 10**15 - 1)} of the set, item {rng.randint(10**16, 10**17)}",
        lambda: f"proxy http://{name()}.net:8080 and mail {name()}@{name()}.org",
        lambda: f"{rng.randint(2000, 2024)}-0{rng.randint(1, 9)}-11T10:{rng.randint(10, 59)}:07.{rng.randint(100, 999)}Z {name()} started",
        lambda: f"token = tokenizer.{name()}(text)[{rng.randint(0, 9)}]",
    ]
    return [(secret[i // 2 % len(secret)](), True) if i % 2 else (plain[i // 2 % len(plain)](), False) for i in range(n)]


def test_findings_of_other_making(spark):
    rows = findings(1400)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    hit = {r.doc_id for r in secrets.find_secrets(spark, docs).select("doc_id").distinct().collect()}
    both = sum(i in hit for i, (_, s) in enumerate(rows) if s)
    precision, recall = both / max(1, len(hit)), both / sum(s for _, s in rows)
    lost = {}
    for i, (t, s) in enumerate(rows):
        if s != (i in hit):
            lost.setdefault((s, i // 2 % (10 if s else 14)), []).append(t)
    print({k: (len(v), v[0]) for k, v in lost.items()}, precision, recall)
    assert precision >= 0.9 and recall >= 0.9, (precision, recall)
