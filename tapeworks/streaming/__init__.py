"""tapeworks.streaming"""
