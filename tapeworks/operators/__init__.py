"""tapeworks.operators"""
