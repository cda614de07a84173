from __future__ import annotations

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from norrsken.schemas import PICKS, RESEARCH
from norrsken.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(
        cores=4, shuffle_partitions=4, checkpoint_dir=str(tmp_path_factory.mktemp("shared"))
    )


_DEFAULTS = dict(
    name=None, ticker="QUAL", country="SE", exchange="Nasdaq Stockholm", segment="main_market",
    sector="Software", market_cap_eur_m=180.0, listing_currency="SEK", price=None,
    catalysts=[], risks=[], evidence=[], data_quality="partial",
)


def research_rows(*rows: dict) -> list[dict]:
    shaped = []
    for number, row in enumerate(rows):
        full = {**_DEFAULTS, **row}
        full["name"] = full["name"] or f"{full['ticker']} AB"
        shaped.append({**{f.name: full.get(f.name) for f in RESEARCH.fields}, "ordinal": number,
                       "run": full.get("run")})
    return shaped


@pytest.fixture(scope="session")
def research(spark):
    schema = StructType(
        [*RESEARCH.fields, StructField("ordinal", LongType()), StructField("run", StringType())]
    )

    def build(*rows: dict):
        return spark.createDataFrame(research_rows(*rows), schema)

    return build


@pytest.fixture(scope="session")
def picks_frame(spark):
    def build(*rows: dict):
        shaped = []
        for row in rows:
            full = dict(
                strategy="trading", ticker="STABL", country="SE", name="Stable AB",
                entry_price=0.85, entry_currency="SEK", reasons=[], warnings=[], risks=[],
            )
            full.update(row)
            full.setdefault(
                "pick_id",
                f"{full['report_date']}|{full['strategy']}|{full['country']}|{full['ticker']}",
            )
            shaped.append({f.name: full.get(f.name) for f in PICKS.fields})
        return spark.createDataFrame(shaped, PICKS)

    return build
