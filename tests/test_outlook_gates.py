"""The gates of outlook sentences, by basin; as a whole this test failed before the gates were ported."""

from stormframe.plans import outlook
from stormframe.sources import products

TWO = "{head}\n\nFor the {sea}:\n\n{title}{prose}\n\n* Formation chance through 48 hours...low...near 20 percent.\n* Formation chance through 7 days...medium...50 percent.\n\n$$"
CASES = [
    ("AT", "", "Winds pulse between the ridge and the Colombian low near Jamaica.", None),
    ("AT", "", "Winds are strong in the gale warning area near Jamaica.", None),
    ("AT", "", "A gap wind event area is near Jamaica.", "set"),
    ("EP", "", "A gap wind event is near Jamaica with the Panama low.", None),
    ("EP", "", "A Tehuantepec wind area is near Jamaica.", None),
    ("AT", "", "The GFS shows a low near Jamaica.", None),
    ("AT", "", "Refer to the text on the wave near Jamaica.", None),
    ("AT", "", "Guidance shows that a low is near Jamaica.", "set"),
    ("AT", "", "The wave near Jamaica moved into the eastern Pacific.", None),
    ("EP", "", "The wave near Jamaica moved into the eastern Pacific.", "set"),
    ("EP", "", "The low near Jamaica moved inland.", None),
    ("AT", "", "The low near Jamaica moved inland.", "set"),
    ("EP", "", "A wave near Jamaica went west of 140W.", None),
    ("AT", "", "A disturbed area near Jamaica bears watching.", "set"),
    ("AT", "", "A storm with a circulation is near Jamaica.", None),
    ("AT", "1. Jamaica (AL92):\n", "The GFS shows a low.", "set"),
]


def test_gates(spark):
    files, expected = [], {}
    for k, (basin, title, prose, wanted) in enumerate(CASES):
        name = f"TWO{basin}.2026080811{k:02d}.txt"
        expected[name] = (18.0, -77.0) if wanted else (None, None)
        head = f"ABNT20 KNHC 081146\nTWO{basin}"
        files.append((name, TWO.format(head=head, sea="Ocean", title=title, prose=prose)))
    named = products.name_products(spark.createDataFrame(files, "file string, text string"))
    got = {r["file"]: (r["lat"], r["lon"]) for r in outlook.disturbances(named, {"jamaica": (18.0, -77.0)}).collect()}
    assert got == expected
