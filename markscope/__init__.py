"""markscope: web markup analytics as Spark DataFrame operations.

Pages go in as a DataFrame (from a page table or from WARC text), come out as
fact tables (elements, attributes, links, images, comments, messages), page
results, per-page counts and corpus totals.  Everything is expressed with
built-in Spark SQL functions so that Catalyst can prune, push down and
code-generate the plan.
"""

from markscope.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
