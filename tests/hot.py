"""Runs the order-dependent queries with every case treated as hot."""
import sys, os
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from eventloom.operators import sequence
sequence.LARGE_ROWS, sequence.PART_ROWS = 30, 5000
import compare
compare.main(sys.argv[1:])
