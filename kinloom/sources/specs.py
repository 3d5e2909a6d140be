"""S3: the sources that are merged, in the order in which they are loaded."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SourceSpec:
    """priority: of its values where sources disagree, lowest first; kind: the stager of its rows."""

    name: str
    kind: str
    header: tuple[str, ...]
    email_index: int | None
    priority: int


APPLICANTS = SourceSpec("applicants.csv", "applicants", ("Full Name", "Email", "Phone", "City", "Experience (Years)", "Current CTC", "Applied Date", "Skills"), 1, 0)
GIG_WORKERS = SourceSpec("gig_workers.csv", "gig_workers", ("email_id", "worker_name", "rate", "location", "status", "skill_tags"), 0, 2)
CONTACTS = SourceSpec("contacts.csv", "contacts", ("Name", "Phone Number", "City", "Verified", "Projects Completed"), None, 1)
SOURCES = (APPLICANTS, GIG_WORKERS, CONTACTS)
