"""All registered queries: name -> (Spark query, SQL twin or None)."""

from __future__ import annotations

from lumenframe.plans.catalog.branch_queries import BRANCH_QUERIES
from lumenframe.plans.catalog.cohort_queries import COHORT_QUERIES
from lumenframe.plans.catalog.landmark_queries import LANDMARK_QUERIES
from lumenframe.plans.catalog.lattice_queries import LATTICE_QUERIES
from lumenframe.plans.catalog.review_queries import REVIEW_QUERIES

REGISTRY = {**LANDMARK_QUERIES, **REVIEW_QUERIES, **LATTICE_QUERIES, **COHORT_QUERIES, **BRANCH_QUERIES}
