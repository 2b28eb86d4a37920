"""Operators for building training corpora: one module per operator.

Nothing outside this folder imports it.  Kernels run as ``mapInArrow`` over
whole texts; everything that meets across documents is a DataFrame operation.
"""
