from quern.llm import names as N


def classes(spark, kind, given):
    df = spark.createDataFrame([(kind, x, "z") for x in given], "name_kind string, name string, core string")
    out = {}
    for r in N.link_names(df).collect():
        out.setdefault(r["class_id"], set()).add(r["name"])
    return sorted(sorted(x) for x in out.values())


def test_companies(spark):
    same = [
        "Varlo Stonegate Fisheries Ltd", "VARLO STONEGATE FISHERIES", "Fisheries, Varlo Stonegate", "Varlo Stone Gate Fish. Limited", "Varlo Stonegaet Ltd t/a Varl Fisheries",
        "Stonegate Varlo Fisheries Ltd", "Várlo Stone-Gate Fisheries Ltd.", "Varlo S.G. Fisheries", "Varlo S'gate Fisheries Ltd", "Varlo Stoneg. Fisheries (formerly Varl Fisheries)",
    ]
    other = ["Varlo Northmill Fisheries Ltd", "Kembus Stonegate Fisheries Ltd", "Kembus Oldwharf Foods"]
    got = classes(spark, "company", same + other + [None])
    assert sorted(same) in got and len(got) == 4


def test_firms_with_equal_words_and_other_trades_stay_apart(spark):
    got = classes(spark, "company", ["Varlo Stonegate Bakery", "Stonegate Varlo Fisheries", "Varlo Stonegate Fisheries Ltd", "Varlo Stonegate Fish.", "Varlo Stonegate", "Kembus Oldwharf Foods", "Kembus Oldwharf"])
    assert got == [["Kembus Oldwharf", "Kembus Oldwharf Foods"], ["Stonegate Varlo Fisheries", "Varlo Stonegate Fish.", "Varlo Stonegate Fisheries Ltd"], ["Varlo Stonegate"], ["Varlo Stonegate Bakery"]]


def test_a_full_spelling_stays_in_the_join_beside_a_shortened_one(spark):
    got = classes(spark, "company", ["Varlo Stonegate", "Varlo Stonegate.", "Varlo Stonegaet"])
    assert len(got) == 1
    got = classes(spark, "company", ["Varlo Stonegate", "Varlo Stonegate.", "Varlo Sandhill", "Varlo Sandhill."])
    assert len(got) == 2


def test_a_swap_in_each_word_is_found(spark):
    got = classes(spark, "company", ["Notapi Kudiba", "Ntoapi Kduiba", "Ranumo Bigebi", "Rnaumo Bgiebi"])
    assert got == [["Notapi Kudiba", "Ntoapi Kduiba"], ["Ranumo Bigebi", "Rnaumo Bgiebi"]]


def test_all_readings_of_many_nicknames():
    forms = N.read_contact("Ted Dolly Kitty Pat Willy Dornebal", {"ted": ["edward", "theodore"], "dolly": ["dolores", "dorothy"], "kitty": ["katherine", "ekaterina"], "pat": ["patricia", "patrick"], "willy": ["wilhelm", "william"]})["forms"]
    assert len(forms) == 32 and "theodore dorothy ekaterina patrick william dornebal" in forms


def test_contacts(spark):
    same = ["Katherine Dornebal", "Dornebal, Katherine", "Kate Dornebal", "K. Dornebal", "Dr. Katherine L. Dornebal", "KATHERINE DORNEBLA", "Dornebal Katherine", "Kat. Dornebal"]
    other = ["Robert Dornebal", "Katherine Pelvinor"]
    got = classes(spark, "contact", same + other)
    assert sorted(same) in got and len(got) == 3


def test_an_initial_that_fits_two_persons_joins_neither(spark):
    got = classes(spark, "contact", ["John Dornebal", "James Dornebal", "J. Dornebal"])
    assert len(got) == 3


def test_a_nickname_of_two_names_joins_the_only_one_there_is(spark):
    got = classes(spark, "contact", ["Ted Dornebal", "Edward Dornebal", "Theodore Dornebal", "Ted Pelvinor", "Theodore Pelvinor", "Pelvinor, Teddy", "Ted Kurtamon", "Teddy Kurtamon"])
    assert got == [["Edward Dornebal"], ["Pelvinor, Teddy", "Ted Pelvinor", "Theodore Pelvinor"], ["Ted Dornebal"], ["Ted Kurtamon", "Teddy Kurtamon"], ["Theodore Dornebal"]]


def test_a_shortened_firm_joins_the_one_of_its_trade_and_the_closest(spark):
    got = classes(spark, "company", ["Varlo N.T. Bakery", "Varlo Norththorn Bakery", "Varlo Northford", "Kembus Northm. Brew. Ltd", "Kembus North Thorn Brothers", "Kembus Northmill Brewing", "Glellilex Foods Sunprot.", "Glellilex Sunport Foods", "Brewg, Zamsavo Bluebrook", "Zamsavo Bluebrook Brewing"])
    assert got == [["Brewg, Zamsavo Bluebrook", "Zamsavo Bluebrook Brewing"], ["Glellilex Foods Sunprot.", "Glellilex Sunport Foods"], ["Kembus North Thorn Brothers"], ["Kembus Northm. Brew. Ltd", "Kembus Northmill Brewing"], ["Varlo N.T. Bakery", "Varlo Norththorn Bakery"], ["Varlo Northford"]]


def test_kinds_do_not_mix_and_empty_input(spark):
    df = spark.createDataFrame([("company", "Ann Dornebal"), ("contact", "Ann Dornebal"), ("contact", "  ")], "name_kind string, name string")
    assert len({r["class_id"] for r in N.link_names(df).collect()}) == 2
    assert N.link_names(df.where("false")).collect() == []


def test_pairs_of_records(spark):
    records = spark.createDataFrame(
        [("contact", "c:B", "Ann Dornebal"), ("contact", "c:A", "Ann Dornebal"), ("contact", "c:A", "Ann Dornebal"), ("contact", "c:C", "Anna Pelvinor"), ("contact", "c:D", None)],
        "name_kind string, key string, name string",
    )
    members = N.class_members(records, N.link_names(records))
    assert [tuple(r) for r in N.class_pairs(members).collect()] == [("contact", "c:A", "c:B")]
    assert members.count() == 3


def test_very_long_and_odd_names():
    trades = N.Trades(N.TRADE_WORDS)
    assert N.read_company("x" * 10_000, trades)["parts"] == ["x" * 10_000]
    assert N.read_company("&&", trades) is None and N.read_contact(".") is None
    assert N.read_company("Ltd", trades)["core"] == "ltd"
    assert N.read_company("北京 茶馆", trades)["core"]
    assert len(N.read_company("ab " * 5000, trades)["forms"]) == 1 and len(N.read_contact("Pat " * 5000)["forms"]) == 1


def test_very_long_names_in_the_join(spark):
    long = "varlo stonegate " * 3000
    got = classes(spark, "company", [long, long + "x", "Varlo Stonegate", long.replace("gate", "gaet", 1)])
    assert sorted(map(len, got)) == [1, 3]


def test_persons_with_short_given_names_that_differ_by_a_letter_stay_apart(spark):
    given = ["John Pelvinor", "Joan Pelvinor", "Jean Pelvinor", "Anna Pelvinor", "Hanna Pelvinor"]
    assert len(classes(spark, "contact", given)) == 5


def test_a_slip_in_a_short_name_is_known_by_its_rarity(spark):
    syllables = ["dor", "pel", "vin", "kur", "sol", "mar", "tes", "bon"]
    given = [f"Bruno {a.title()}{b}inor" for a in syllables for b in syllables] + ["Brwuno Dordorinor"]
    assert ["Bruno Dordorinor", "Brwuno Dordorinor"] in classes(spark, "contact", given)


def test_initials_that_fit_nobody_stay_apart(spark):
    assert len(classes(spark, "contact", ["J. Smith", "Jo. Smith", "Jas. Smith"])) == 3
    assert classes(spark, "contact", ["J. Smith", "Smith, J."]) == [["J. Smith", "Smith, J."]]


def test_trades_that_no_list_has(spark):
    """Cut off by a stop they are joined; different ones stay apart."""
    got = classes(spark, "company", ["Varlo Stonegate Zorbing Ltd", "Varlo Stonegate Zorb. Ltd", "Kembus Oldwharf Plumbing Ltd", "Kembus Oldwharf Plumb. Ltd", "Varlo Stonegate Quilting Ltd"])
    assert got == [["Kembus Oldwharf Plumb. Ltd", "Kembus Oldwharf Plumbing Ltd"], ["Varlo Stonegate Quilting Ltd"], ["Varlo Stonegate Zorb. Ltd", "Varlo Stonegate Zorbing Ltd"]]


def test_different_firms_with_one_word_and_other_trades(spark):
    got = classes(spark, "company", ["Varlo Foods", "Varlo Bakery", "Varlo Stonegate Foods Ltd", "Varlo Stonegate Fisheries Ltd", "Varlo Stonegate Bakery"])
    assert len(got) == 5


def test_trades_are_learnt_from_names_and_not_from_a_firm_with_many_spellings(spark):
    firms = [f"{a}{b} Stone{c} {t}" for t in ("Zorbing", "Quilting") for a in ("Kel", "Mor", "Vas") for b in ("dan", "bus", "tip", "rom") for c in ("gate", "mill")]
    many = ["Dulmador Northlode" + "." * i for i in range(60)]
    df = spark.createDataFrame([(x,) for x in firms + many], "name string")
    assert N.learn_trades(df) == ["quilting", "zorbing"]
    assert N.learn_trades(df.where("false")) == []
    got = classes(spark, "company", [*firms, "Keldan Stonegate Zrbng", "Keldan Stonegate Quilt.", "Keldan Stonegaet Zorbing"])
    assert ["Keldan Stonegaet Zorbing", "Keldan Stonegate Zorbing", "Keldan Stonegate Zrbng"] in got


def test_nicknames_with_a_doubled_letter_follow_from_the_short_forms():
    table = N.nickname_table("thomas: tom; theodore: ted theo; edward: ed ted; patricia: pat patty; patrick: pat")
    assert table["tommy"] == table["tom"] == ["thomas"] and table["teddy"] == ["theodore", "edward"] and table["patty"] == ["patricia"]
