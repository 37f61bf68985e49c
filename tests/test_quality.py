"""The product against labels of our own, and its independence of partitioning."""

import pytest

from tendrel.operators import verdict
from tendrel.plans import pipeline
from tendrel.sources import readers

LIBRARY = {
    "desk.md": """# Service desk
Our service desk answers calls around the clock, every day of the year, from two sites. Ninety percent of calls are picked up within twenty seconds and each call is logged as a ticket with a priority.
# Escalation
Major incidents are escalated to a duty manager within fifteen minutes and an incident bridge is opened. Stakeholders get hourly updates and a root cause report within five working days.
# Onboarding of users
New users are onboarded with a guided session, printed guides and recorded training videos in plain language.
""",
    "security.md": """# Backups
Encrypted backups of all databases are taken nightly and copied to a second data centre. Restores are rehearsed each quarter and the restore time is reported.
# Access control
Access to systems needs multi-factor authentication. Privileged accounts are reviewed monthly and leavers lose access the same day.
# Vulnerability scanning
Servers are scanned for vulnerabilities weekly; critical patches are installed within three days of release.
""",
    "people.md": """# Team
The account is led by a named service manager with an ITIL expert certificate, supported by six engineers who hold current vendor certificates.
# Transition
Transition runs over eight weeks with a cutover plan, parallel running and a rollback point at each stage.
""",
}
#: (clause, label)
TENDER = (
    ("The Supplier shall operate a service desk around the clock every day of the year.", "COVERED"),
    ("The Supplier shall log each call as a ticket with a priority.", "COVERED"),
    ("Major incidents must be escalated to a duty manager within fifteen minutes.", "COVERED"),
    ("The Supplier shall take encrypted backups of databases nightly.", "COVERED"),
    ("Restores must be rehearsed each quarter.", "COVERED"),
    ("Access to systems shall need multi-factor authentication.", "COVERED"),
    ("Privileged accounts must be reviewed monthly.", "COVERED"),
    ("Servers shall be scanned for vulnerabilities weekly.", "COVERED"),
    ("The Supplier shall name a service manager with an ITIL certificate.", "COVERED"),
    ("Transition shall include parallel running and a rollback point.", "COVERED"),
    ("The Supplier must publish a carbon reduction plan for its fleet.", "GAP"),
    ("The Supplier shall hold professional indemnity insurance of ten million pounds.", "GAP"),
    ("Printers must be replaced with refurbished models under a leasing scheme.", "GAP"),
    ("The Supplier shall pay the real living wage to all cleaning staff.", "GAP"),
    ("Telephone handsets shall support hearing aid compatibility.", "GAP"),
    ("Encrypted backups shall be stored on tape in a vault owned by the Authority for seven years.", "PARTIAL"),
)


@pytest.fixture()
def library(spark, tmp_path):
    for name, text in LIBRARY.items():
        (tmp_path / name).write_text(text)
    return readers.load_corpus(spark, tmp_path)[0]


def assessed(spark, library):
    text = "# Requirements\n" + "\n".join(f"{n}.1 {clause}" for n, (clause, _) in enumerate(TENDER, 1))
    return pipeline.tender_coverage(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), library)


def test_quality_gate(spark, library):
    """No gap and no partial answer is called answered; at most two covered clauses are lost."""
    labels = spark.createDataFrame([(f"{n}.1", label) for n, (_, label) in enumerate(TENDER, 1)], "ref string, label string")
    got = verdict.evaluation(assessed(spark, library), labels, "ref").first()
    assert got["unmatched"] == 0 and got["gaps"] == 5 and got["covered"] == 10
    assert got["false_confidence"] == 0 and got["false_gaps"] <= 2 and got["gaps_found"] >= 4


def test_results_do_not_depend_on_partitioning(spark, library):
    results, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    chunks = library.cache()
    try:
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = verdict.action_order(assessed(spark, chunks.repartition(n))).drop("key").collect()
            results.append([tuple(r) for r in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2] and len(results[0]) == len(TENDER)
