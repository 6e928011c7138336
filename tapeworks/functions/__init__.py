"""tapeworks.functions"""
