"""Reports: compositions of the operators, each a function from tables to one lazy plan.

``t`` is any object with the methods of ``sources.tables.Warehouse``; its tables carry the
canonical columns. Every report takes its clock and thresholds as arguments.
"""
