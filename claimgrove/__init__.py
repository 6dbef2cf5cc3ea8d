"""Evidence analytics for disclosure corpora, as lazy Spark DataFrame functions."""

from claimgrove.session import cut_lineage, local_session, prepare, small_side

__all__ = ["cut_lineage", "local_session", "prepare", "small_side"]
