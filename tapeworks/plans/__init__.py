"""tapeworks.plans"""
