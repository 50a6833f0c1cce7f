"""Founder-signal analytics as Spark jobs: signals, identities, claims, scores, screening, views and audits."""
