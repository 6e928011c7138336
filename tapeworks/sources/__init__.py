"""tapeworks.sources"""
